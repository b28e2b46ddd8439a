"""Pseudotime bins: equal-frequency, Gaussian and planned kernels, and their aggregates.

cells(cell_id, pseudotime, branch); entries(cell_id, feature_id, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import quantiles
from strandline.storage import written

def bin_count(n: Column, least_cells: int, most_bins: int) -> Column:
    return F.greatest(F.lit(5), F.least(F.floor(n / least_cells), F.lit(most_bins))).cast("int")


def smooth_bin_count(n: Column, least_cells: int, target: int, overlap: float) -> Column:
    return F.greatest(F.lit(5), F.least(F.lit(target), F.floor(F.lit(overlap) * n / least_cells))).cast("int")


def max_lag(n_bins: int, asked: int | str | None = "auto") -> int:
    return max(1, n_bins // 4) if asked in ("auto", None) or int(asked) <= 0 else int(asked)


def equal_frequency_edges(cells: DataFrame, n_bins: int) -> DataFrame:
    """(branch, edges): distinct linear-interpolated quantiles of pseudotime, exact, the outer ones among them."""
    return quantiles(cells, "branch", "pseudotime", [k / n_bins for k in range(n_bins + 1)]).select("branch", F.array_distinct("edges").alias("edges"))


def assign_bins(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds bin: the number of inner edges below the time (right-closed, lowest included). Edges are one row a branch."""
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return cells.join(F.broadcast(edges), "branch").withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("pseudotime")))).drop("edges")


def equal_frequency_bins(cells: DataFrame, n_bins: int) -> DataFrame:
    return assign_bins(cells, equal_frequency_edges(cells, n_bins))


def hard_bin_means(entries: DataFrame, binned: DataFrame, empty_as_zero: bool = True) -> DataFrame:
    """Mean of each feature in each (branch, bin) over the bin's cells, absent entries being 0.

    With empty_as_zero every feature has a row in every bin that has cells.
    """
    sizes = binned.groupBy("branch", "bin").agg(F.count("*").alias("n_cells"))
    # entries are aggregated once; those of cells without a bin only name their features
    sums = written(entries.join(binned.select("cell_id", "branch", "bin"), "cell_id", "left").groupBy("branch", "bin", "feature_id").agg(F.sum("value").alias("_s")), "bin-sums")
    if not empty_as_zero:
        return sums.join(F.broadcast(sizes), ["branch", "bin"]).select("branch", "bin", "feature_id", (F.col("_s") / F.col("n_cells")).alias("value"))
    grid = sums.select("feature_id").distinct().crossJoin(F.broadcast(sizes))
    return grid.join(sums, ["branch", "bin", "feature_id"], "left").select("branch", "bin", "feature_id", (F.coalesce("_s", F.lit(0.0)) / F.col("n_cells")).alias("value"))


def kernel_centres(cells: DataFrame, n_bins: int, least_cells: int) -> DataFrame:
    """(branch, bin, centre, width): midpoints of equal time spans and Gaussian widths."""
    spans = cells.groupBy("branch").agg(F.min("pseudotime").alias("_lo"), F.max("pseudotime").alias("_hi"), F.count("*").alias("_n"))
    step = (F.col("_hi") - F.col("_lo")) / n_bins
    width = step * F.greatest(F.lit(1.0), F.lit(float(least_cells)) / (F.col("_n") / n_bins))
    rows = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return rows.select("branch", "bin", (F.col("_lo") + step * (F.col("bin") + 0.5)).alias("centre"), width.alias("width"))


def kernel_weights(cells: DataFrame, centres: DataFrame, least: float = 0.0) -> DataFrame:
    """(branch, bin, cell_id, w): Gaussian weights of a branch's cells in its bins; bins are at most some hundred rows."""
    w = F.exp(-0.5 * F.pow((F.col("centre") - F.col("pseudotime")) / F.when(F.col("width") > 0, F.col("width")), 2))
    return cells.join(F.broadcast(centres), "branch").select("branch", "bin", "cell_id", F.coalesce(w, F.lit(1.0)).alias("w")).where(F.col("w") > least)


def kernel_means(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of each feature in each bin: sum(w v) / (sum(w) + 1e-10)."""
    totals = weights.groupBy("branch", "bin").agg(F.sum("w").alias("_w"))
    sums = entries.join(weights, "cell_id").groupBy("branch", "bin", "feature_id").agg(F.sum(F.col("w") * F.col("value")).alias("_s"))
    return sums.join(F.broadcast(totals), ["branch", "bin"]).select("branch", "bin", "feature_id", (F.col("_s") / (F.col("_w") + 1e-10)).alias("value"))


def membership(weights: DataFrame) -> DataFrame:
    """Each cell's weights over its bins, summing to 1."""
    own = Window.partitionBy("cell_id")
    return weights.withColumn("w", F.col("w") / F.sum("w").over(own))


def bin_diagnostics(weights: DataFrame, cells: DataFrame, support: float = 1e-3) -> DataFrame:
    """Effective sample size, supporting cells, mean and spread of time in each bin."""
    joined = weights.join(cells.select("cell_id", "pseudotime"), "cell_id")
    w, t = F.col("w"), F.col("pseudotime")
    sums = joined.groupBy("branch", "bin").agg(F.sum("w").alias("_w"), F.sum(w * w).alias("_q"), F.sum((w > support).cast("long")).alias("support"), F.sum(w * t).alias("_t"), F.sum(w * t * t).alias("_tt"))
    mean = F.col("_t") / F.col("_w")
    return sums.select("branch", "bin", (F.col("_w") * F.col("_w") / F.col("_q")).alias("ess"), "support", mean.alias("time_mean"), F.sqrt(F.greatest(F.col("_tt") / F.col("_w") - mean * mean, F.lit(0.0))).alias("time_sd"))


def neighbour_overlap(weights: DataFrame) -> DataFrame:
    """Cosine of the weights of each bin and the next of its branch."""
    nxt = weights.select("branch", (F.col("bin") - 1).alias("bin"), "cell_id", F.col("w").alias("w2"))
    cross = weights.join(nxt, ["branch", "bin", "cell_id"]).groupBy("branch", "bin").agg(F.sum(F.col("w") * F.col("w2")).alias("_x"))
    norm = weights.groupBy("branch", "bin").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    after = norm.select("branch", (F.col("bin") - 1).alias("bin"), F.col("_n").alias("_m"))
    return cross.join(norm, ["branch", "bin"]).join(after, ["branch", "bin"]).select("branch", "bin", (F.col("_x") / (F.col("_n") * F.col("_m"))).alias("overlap"))


def ess_bandwidth(cells: DataFrame, centres: DataFrame, multipliers: list[float], target_ess: float) -> DataFrame:
    """For each bin the smallest multiplier of its width whose effective sample size meets the target, else the largest."""
    wide = centres.withColumn("multiplier", F.explode(F.array(*(F.lit(m) for m in multipliers))))
    w = F.exp(-0.5 * F.pow((F.col("centre") - F.col("pseudotime")) / (F.col("width") * F.col("multiplier")), 2))
    ess = cells.join(F.broadcast(wide.where("width > 0")), "branch").groupBy("branch", "bin", "width", "multiplier").agg((F.pow(F.sum(w), 2) / F.sum(w * w)).alias("ess"))
    best = F.coalesce(F.min(F.when(F.col("ess") >= target_ess, F.col("multiplier"))), F.max("multiplier"))
    return ess.groupBy("branch", "bin", "width").agg(best.alias("multiplier"), F.max("ess").alias("most_ess")).withColumn("width", F.col("width") * F.col("multiplier"))


def frozen_membership(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Bins of new cells under frozen edges; times outside the edges get no bin."""
    inside = F.col("pseudotime").between(F.element_at("edges", 1), F.element_at("edges", -1))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return cells.join(F.broadcast(edges), "branch", "left").withColumn("bin", F.when(inside, F.size(F.filter(inner, lambda e: e < F.col("pseudotime"))))).drop("edges")


def boundary_regions(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds region: the cuts of the branch at or below the time, so that a cut belongs to its right side."""
    listed = cuts.groupBy("branch").agg(F.sort_array(F.collect_set("cut")).alias("_cuts"))
    return cells.join(F.broadcast(listed), "branch", "left").withColumn("region", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("pseudotime"))), F.lit(0))).drop("_cuts")


def merge_small_branches(cells: DataFrame, least_cells: int) -> DataFrame:
    """Cells with branches below least_cells renamed to the large branch of nearest median time (ties to the smaller name)."""
    mid = written(cells.groupBy("branch").agg(F.count("*").alias("n")).join(quantiles(cells, "branch", "pseudotime", [0.5]).select("branch", F.col("edges")[0].alias("mid")), "branch"), "medians")
    small, large = mid.where(F.col("n") < least_cells), mid.where(F.col("n") >= least_cells)
    pairs = small.select(F.col("branch"), "mid").crossJoin(F.broadcast(large.select(F.col("branch").alias("to"), F.col("mid").alias("to_mid"))))
    moved = pairs.groupBy("branch").agg(F.min_by("to", F.struct(F.abs(F.col("mid") - F.col("to_mid")), "to")).alias("to"))
    return cells.join(F.broadcast(moved), "branch", "left").withColumn("branch", F.coalesce("to", "branch")).drop("to")


def allocate_bins(sizes: dict, n_bins: int, least: int = 3) -> dict:
    """Bins of each branch in proportion to its cells, at least `least`; the rest goes one by one to the branch most short or over."""
    total = sum(sizes.values())
    out = {b: max(least, n_bins * n // total) for b, n in sizes.items()}
    while sum(out.values()) != n_bins:
        up = sum(out.values()) < n_bins
        movable = [b for b in out if up or out[b] > least]
        if not movable:
            break
        gap = {b: n_bins * sizes[b] / total - out[b] for b in movable}
        b = max(sorted(gap, key=str), key=lambda x: gap[x]) if up else min(sorted(gap, key=str), key=lambda x: gap[x])
        out[b] += 1 if up else -1
    return out


def lag_pairs(series: DataFrame, lag: int, keys: list[str]) -> DataFrame:
    """Rows (keys, bin, value, lagged) whose lagged bin is exactly `lag` before in the same branch."""
    order = Window.partitionBy(*keys).orderBy("bin")
    return series.withColumn("lagged", F.lag("value", lag).over(order)).withColumn("_b", F.lag("bin", lag).over(order)).where(F.col("_b") == F.col("bin") - lag).drop("_b")


def effective_rows(weights: DataFrame) -> DataFrame:
    """Kernel effective rows tr(G)^2 / |G|^2 of each branch, with G the Gram matrix of its bins' weights."""
    other = weights.select("branch", "cell_id", F.col("bin").alias("bin2"), F.col("w").alias("w2"))
    g = weights.join(other, ["branch", "cell_id"]).groupBy("branch", "bin", "bin2").agg(F.sum(F.col("w") * F.col("w2")).alias("g"))
    return g.groupBy("branch").agg((F.pow(F.sum(F.when(F.col("bin") == F.col("bin2"), F.col("g"))), 2) / F.sum(F.col("g") * F.col("g"))).alias("effective_rows"))


def root_cells(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """The root of each branch: the cell of largest marker score(cell_id, branch, score), else the one of least total(cell_id, branch, total); ties to the smaller id."""
    best = scores.where("score > 0").groupBy("branch").agg(F.max_by("cell_id", F.struct("score", -F.col("cell_id"))).alias("marked"))
    least = totals.groupBy("branch").agg(F.min_by("cell_id", F.struct("total", "cell_id")).alias("lightest"))
    return least.join(best, "branch", "left").select("branch", F.coalesce("marked", "lightest").alias("root"), F.when(F.col("marked").isNotNull(), "marker").otherwise("least_total").alias("rule"))


def potency(entries: DataFrame, top: int) -> DataFrame:
    """An approximate potency of cells: mean logged value of the `top` features whose values follow the number of detected features most.

    entries(cell_id, feature_id, value) hold logged values. Absent entries count as 0 in the correlation.
    """
    counts = entries.groupBy("cell_id").agg(F.sum((F.col("value") > 0).cast("double")).alias("g"))
    whole = counts.agg(F.count("*").alias("n"), F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sgg"))
    s = entries.join(counts, "cell_id").groupBy("feature_id").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"), F.sum(F.col("value") * F.col("g")).alias("sxg")).crossJoin(F.broadcast(whole))
    cov, vx, vg = F.col("n") * F.col("sxg") - F.col("sx") * F.col("sg"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("sgg") - F.col("sg") * F.col("sg")
    r = F.when((vx > 1e-9) & (vg > 1e-9), cov / F.sqrt(F.when((vx > 1e-9) & (vg > 1e-9), vx * vg)))
    signature = s.select("feature_id", r.alias("r")).where("r is not null").orderBy(F.desc(F.round("r", 9)), "feature_id").limit(top)
    picked = entries.join(F.broadcast(signature.select("feature_id")), "feature_id").groupBy("cell_id").agg((F.sum("value") / top).alias("potency"))
    return counts.join(picked, "cell_id", "left").select("cell_id", F.coalesce("potency", F.lit(0.0)).alias("potency"))
