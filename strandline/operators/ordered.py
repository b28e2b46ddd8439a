"""Running sums, minima and neighbours along an order, without one task for a group.

Rows are dealt to range partitions of the order and written once. Windows run inside a part; a table with one row a
part and group carries what the parts before or after bring, so that the largest task is a range, not a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import shuffle_parts, written


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows in range partitions of the columns `order`, with the part's number as _part; written, so that the parts stay what they are."""
    return written(rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranged")


def counts_below(rows: DataFrame, by: list[str], key: str, count: str) -> DataFrame:
    """Adds _below, the sum of `count` over the group's rows of smaller key, and _all, that over all; (by, key) are distinct."""
    parts = ranged(rows, *by, key)
    sums = parts.groupBy(*by, "_part").agg(F.sum(count).alias("_k"))
    own = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_k").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_part", before.alias("_start"), F.sum("_k").over(own).alias("_all"))
    here = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(sums), [*by, "_part"])
    return joined.withColumn("_below", F.col("_start") + F.coalesce(F.sum(count).over(here), F.lit(0))).drop("_start")


def least_from_here(rows: DataFrame, by: list[str], key: str, value: Column) -> DataFrame:
    """Adds _least, the smallest value among the group's rows of the same key or a larger one; rows come from counts_below."""
    valued = rows.withColumn("_v", value)
    tops = valued.groupBy(*by, "_part").agg(F.min("_v").alias("_m"))
    after = F.min("_m").over(Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*by, "_part", after.alias("_after"))
    here = Window.partitionBy(*by, "_part").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return valued.join(F.broadcast(tops), [*by, "_part"]).withColumn("_least", F.least(F.min("_v").over(here), F.col("_after"))).drop("_v", "_after")


def quantiles(rows: DataFrame, by: str, key: str, cuts: list[float]) -> DataFrame:
    """(by, edges): linear-interpolated quantiles of key in each group, at the positions (n - 1) q of the sorted values."""
    kinds = counts_below(rows.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count("*").alias("_k")), [by], key, "_k")
    listed = "array(" + ", ".join(f"{float(q)!r}D" for q in cuts) + ")"
    ranks = F.expr(f"array_distinct(flatten(transform({listed}, q -> array(floor((_all - 1) * q), least(floor((_all - 1) * q) + 1, _all - 1)))))")
    hit = kinds.withColumn("_r", F.filter(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_k")))).where(F.size("_r") > 0)
    found = hit.groupBy(by).agg(F.max("_all").alias("_all"), F.map_from_entries(F.flatten(F.collect_list(F.transform("_r", lambda r: F.struct(r.alias("k"), F.col(key).cast("double").alias("v")))))).alias("_at"))
    ends = f"transform({listed}, q -> struct(element_at(_at, floor((_all - 1) * q)) AS low, element_at(_at, least(floor((_all - 1) * q) + 1, _all - 1)) AS high, (_all - 1) * q - floor((_all - 1) * q) AS t))"
    # from the nearer end, so that a cut on a value is that value
    return written(found.select(by, F.expr(f"transform({ends}, x -> CASE WHEN x.t = 0 THEN x.low WHEN x.t < 0.5 THEN x.low + (x.high - x.low) * x.t ELSE x.high - (x.high - x.low) * (1 - x.t) END)").alias("edges")), "quantiles")


def neighbours_along(rows: DataFrame, by: str, order: list[str], here: Column) -> DataFrame:
    """Adds _left and _right: the last non-null `here` at or before a row, and the first at or after it, in the group's order.

    order's columns break ties of all rows, so that rows at one place may lie in several parts.
    """
    parts = ranged(rows.withColumn("_here", here), by, *order)
    inside = Window.partitionBy(by, "_part")
    up, down = (inside.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, [F.desc(c) for c in order]))
    ends = parts.where("_here is not null").groupBy(by, "_part").agg(F.max_by("_here", F.struct(*order)).alias("_last"), F.min_by("_here", F.struct(*order)).alias("_first"))
    ends = parts.select(by, "_part").distinct().join(ends, [by, "_part"], "left")
    line = Window.partitionBy(by)
    carried = [F.last(c, True).over(line.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)) for c, o in (("_last", "_part"), ("_first", F.desc("_part")))]
    ends = ends.select(by, "_part", carried[0].alias("_before"), carried[1].alias("_after"))
    joined = parts.join(F.broadcast(ends), [by, "_part"])
    return joined.withColumn("_left", F.coalesce(F.last("_here", True).over(up), "_before")).withColumn("_right", F.coalesce(F.last("_here", True).over(down), "_after")).drop("_before", "_after", "_here", "_part")
