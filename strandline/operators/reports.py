"""Tables behind the reports: indirect routes, topology checks, cumulative counts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indirect_routes(up: DataFrame, down: DataFrame) -> DataFrame:
    """Routes source -> middle -> gene of a cluster: up(cluster, source, middle, weight), down(cluster, middle, gene, weight).

    Sums are taken on each side by middle first; the route has both parts, their geometric mean and the product's sign.
    """
    a = up.groupBy("cluster", "source", "middle").agg(F.sum("weight").alias("up"))
    b = down.groupBy("cluster", "middle", "gene").agg(F.sum("weight").alias("down"))
    return a.join(b, ["cluster", "middle"]).select("cluster", "source", "middle", "gene", "up", "down", F.sqrt(F.abs(F.col("up") * F.col("down"))).alias("strength"), F.signum(F.col("up") * F.col("down")).alias("direction"))


def purely_indirect(affected: DataFrame, direct: DataFrame, regulated: DataFrame) -> DataFrame:
    """Affected (cluster, gene) without a direct edge whose gene is regulated in the same cluster."""
    return affected.join(direct, ["cluster", "gene"], "left_anti").join(regulated.select("cluster", "gene").distinct(), ["cluster", "gene"], "left_semi")


def topology_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with the side that has them; none if both hold the same set."""
    cols = left.columns
    return left.exceptAll(right.select(cols)).withColumn("side", F.lit("left")).unionByName(right.select(cols).exceptAll(left).withColumn("side", F.lit("right")))


def cumulative_onsets(onsets: DataFrame, bins: DataFrame) -> DataFrame:
    """Genes whose onset is at or before each (cluster, bin); bins without any keep 0."""
    n = onsets.groupBy("cluster", "bin").agg(F.count("*").alias("n"))
    return bins.join(n, ["cluster", "bin"], "left").select("cluster", "bin", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("cluster").orderBy("bin")), F.lit(0)).alias("n_so_far"))


def shared_targets(edges: DataFrame) -> DataFrame:
    """Adds shared: whether the gene has more than one source."""
    n = edges.groupBy("gene").agg(F.countDistinct("source").alias("_n"))
    return edges.join(n, "gene").withColumn("shared", F.col("_n") > 1).drop("_n")


def keep_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
