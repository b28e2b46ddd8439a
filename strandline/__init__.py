"""strandline: lagged-regulation and perturbation analytics as Spark DataFrame jobs."""
