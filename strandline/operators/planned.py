"""Aggregates under a plan of bins: which bins are valid or reliable, and what invalid ones give.

bins(branch, bin) are all bins of the plan, some hundred rows; weights(branch, bin, cell_id, w) its kernel above the cut-off; entries(cell_id, feature_id, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import written


def planned_bins(weights: DataFrame, bins: DataFrame, least_support: int = 5, separate: bool = True, target_ess: float | None = None) -> DataFrame:
    """(branch, bin, weight, ess, support, valid, reliable) of every bin of the plan, also of those that no cell supports.

    A bin is valid if it has weight and, with separate branches, `least_support` cells; reliable if it is valid with that support in either policy and, where
    `target_ess` is given, that effective sample size. Support counts cells of weight above 0; weights that are null do not count.
    """
    w = F.col("w")
    sums = weights.where("w > 0").groupBy("branch", "bin").agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_q"), F.count("*").alias("_n"))
    zero = F.lit(0.0)
    every = bins.select("branch", "bin").distinct().join(sums, ["branch", "bin"], "left")
    every = every.select("branch", "bin", F.coalesce("_w", zero).alias("weight"), F.coalesce(F.col("_w") * F.col("_w") / F.col("_q"), zero).alias("ess"), F.coalesce("_n", F.lit(0)).alias("support"))
    enough = F.col("support") >= least_support
    valid = (F.col("weight") > 0) & (enough if separate else F.lit(True))
    reliable = valid & enough & (F.col("ess") >= target_ess if target_ess is not None else F.lit(True))
    return every.withColumn("valid", valid).withColumn("reliable", reliable)


def planned_means(entries: DataFrame, weights: DataFrame, planned: DataFrame, separate: bool = True) -> DataFrame:
    """(branch, bin, feature_id, value): sum(w v) / (sum(w) + 1e-10) of every feature of entries in every bin of planned_bins.

    Absent entries are 0. With separate branches an invalid bin gives null for all features, never 0; otherwise a bin without weight gives 0. Reliability changes no value.
    """
    kept = weights.where("w > 0")
    # entries of cells without a bin only name their features
    sums = written(entries.join(kept, "cell_id", "left").groupBy("branch", "bin", "feature_id").agg(F.sum(F.col("w") * F.col("value")).alias("_s")), "planned-sums")
    held = F.broadcast(planned.select("branch", "bin", "weight", "valid"))
    grid = sums.select("feature_id").distinct().crossJoin(held).join(sums, ["branch", "bin", "feature_id"], "left")
    mean = F.coalesce("_s", F.lit(0.0)) / (F.col("weight") + 1e-10)
    return grid.select("branch", "bin", "feature_id", (F.when(F.col("valid"), mean) if separate else mean).alias("value"))


def valid_membership(weights: DataFrame, planned: DataFrame) -> DataFrame:
    """(branch, bin, cell_id, w): each cell's weights over the valid bins in parts of their sum; a cell with none has no row, so its values are unknown, not 0."""
    kept = weights.where("w > 0").join(F.broadcast(planned.where("valid").select("branch", "bin")), ["branch", "bin"], "left_semi")
    return kept.select("branch", "bin", "cell_id", (F.col("w") / (F.sum("w").over(Window.partitionBy("branch", "cell_id")) + 1e-10)).alias("w"))
