"""Training-data operators: text, token and vector jobs over whole Spark tables."""
