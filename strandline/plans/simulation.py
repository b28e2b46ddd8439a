"""Fitted responses and simulated interventions; derived from the tables, checked by tests rather than SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import response, screening, splines
from strandline.plans.cohort import bin_state, lagged_rows
from strandline.plans.frames import cells
from strandline.plans.registry import query
from strandline.storage import written


def pair_rows(spark: SparkSession, sf_dir: str, n_bins: int = 16) -> DataFrame:
    """(target_id, input_id, branch, bin, x, y): each gene on the peaks a bin before that the screening keeps for it."""
    genes, peaks = bin_state(spark, sf_dir, n_bins)
    kept = screening.score_edges(screening.granger(lagged_rows(spark, sf_dir, n_bins), ["gene", "peak"])).where("is_causal")
    kept = written(kept.select(F.col("gene").alias("target_id"), F.col("peak").alias("input_id")), "kept")
    y = genes.select(F.col("feature_id").alias("target_id"), "branch", "bin", F.col("value").alias("y"))
    x = peaks.select(F.col("feature_id").alias("input_id"), "branch", (F.col("bin") + 1).alias("bin"), F.col("value").alias("x"))
    return kept.join(y, "target_id").join(x, ["input_id", "branch", "bin"]).select("target_id", "input_id", "branch", "bin", "x", "y")


def factor_rows(spark: SparkSession, sf_dir: str, n_bins: int = 16) -> DataFrame:
    """(target_id, input_id, branch, bin, x, y): each peak on the genes of its bin that the screening without a lag keeps for it."""
    genes, peaks = bin_state(spark, sf_dir, n_bins)
    y = peaks.select(F.col("feature_id").alias("target_id"), "branch", "bin", F.col("value").alias("y"))
    x = genes.select(F.col("feature_id").alias("input_id"), "branch", "bin", F.col("value").alias("x"))
    rows = written(y.join(x, ["branch", "bin"]), "factors")
    kept = screening.score_edges(screening.contemporaneous(rows, ["target_id", "input_id"])).where("is_causal").select("target_id", "input_id")
    return rows.join(written(kept, "kept"), ["target_id", "input_id"])


@query()
def saturating_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.prune_responses(response.fit_responses(pair_rows(spark, sf_dir), "saturation"), 0.05)


@query()
def spline_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded spline responses of all kept genes to their peaks, with roughness penalty and exponential tails."""
    return splines.fit_splines(pair_rows(spark, sf_dir))


@query()
def network_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.fit_responses(pair_rows(spark, sf_dir), "network")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes on peaks a bin before, and peaks on genes of the same bin, with frozen weights."""
    down, up = pair_rows(spark, sf_dir), factor_rows(spark, sf_dir)
    out = None
    for layer, lag, rows in (("gene", 1, down), ("peak", 0, up)):
        models = written(response.fit_responses(rows, "saturation"), "models")
        seen = rows.join(models, ["target_id", "input_id"]).withColumn("value", response.model_value(F.col("family"), F.col("x"), F.col("params"), F.col("low"), F.col("high"))).withColumn("supported", F.lit(True))
        alpha = screening.frozen_weights(screening.adjacent_changes(seen, ["branch", "target_id", "input_id"]), ["target_id"], ["input_id"]).select("target_id", "input_id", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
        part = models.join(alpha, ["target_id", "input_id"]).select(F.lit(layer).alias("layer"), "target_id", "input_id", F.lit(lag).alias("lag"), "alpha", "family", "params", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def forward_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full, half and zero knock-outs of gene 1 in every branch, bin by bin."""
    genes, peaks = bin_state(spark, sf_dir, 16)
    state = genes.withColumn("layer", F.lit("gene")).unionByName(peaks.withColumn("layer", F.lit("peak"))).withColumn("context", F.col("branch"))
    contexts = cells(spark, sf_dir).select(F.col("branch").alias("context")).distinct()
    asked = contexts.crossJoin(spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.5), (3, 1, 0.0)], "intervention long, feature_id long, strength double"))
    return response.propagate(state, relations(spark, sf_dir), asked)


@query()
def input_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the inputs in the targets' changes when each input falls by a fifth."""
    rows = pair_rows(spark, sf_dir)
    models = response.fit_responses(rows, "saturation")
    weights = models.groupBy("target_id").agg(F.count("*").alias("k")).join(models.select("target_id", "input_id"), "target_id").select("target_id", "input_id", (1 / F.col("k")).alias("alpha"))
    states = rows.select("input_id", (F.col("branch") * 1000 + F.col("bin")).alias("bin"), F.col("x").alias("x_old"), (F.col("x") * 0.8).alias("x_new")).dropDuplicates(["input_id", "bin"])
    return response.contributions(models, weights, states)
