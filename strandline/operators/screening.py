"""Edge screening: lagged regressions of genes on peaks, and local-lag routes of factors to peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.stats import composite_score, f_tail, pearson_tail
from strandline.operators.ordered import counts_below, least_from_here
from strandline.storage import shuffle_parts, written


def granger(rows: DataFrame, keys: list[str], least_variance: float = 1e-6, least_sse: float = 1e-10) -> DataFrame:
    """Reduced and full regressions of y on (l) and (l, x) for each key, in closed form from moments.

    Degenerate pairs (no variance, a rank-deficient or perfect fit, no degrees of freedom) give no row.
    """
    moments = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.var_pop(c).alias(f"v{c}") for c in "ylx"),
        F.covar_pop("y", "l").alias("cyl"), F.covar_pop("y", "x").alias("cyx"), F.covar_pop("l", "x").alias("clx"),
    ).where((F.col("vy") >= least_variance) & (F.col("vx") >= least_variance) & (F.col("vl") > 1e-15) & (F.col("n") > 3))
    r = lambda a, b: F.col(f"c{a}{b}") / F.sqrt(F.col(f"v{a}") * F.col(f"v{b}"))
    moments = moments.select(*keys, "n", "vy", "vx", r("y", "l").alias("ryl"), r("y", "x").alias("ryx"), r("l", "x").alias("rlx"))
    free, apart = 1 - F.col("ryl") ** 2, 1 - F.col("rlx") ** 2
    moments = moments.where((free > 1e-12) & (apart > 1e-12))
    own = F.col("ryx") - F.col("ryl") * F.col("rlx")
    out = moments.withColumn("delta_r2", own * own / (free * apart)).withColumn("sse_reduced", F.col("n") * F.col("vy") * free)
    out = out.withColumn("sse_full", F.col("sse_reduced") * (1 - F.col("delta_r2"))).withColumn("coef", F.sqrt(F.col("vy") / F.col("vx")) * own / apart)
    out = out.where((F.col("sse_reduced") >= least_sse) & (F.col("sse_full") >= least_sse))
    f = F.col("delta_r2") / (1 - F.col("delta_r2")) * (F.col("n") - 3)
    return out.select(*keys, "n", "sse_reduced", "sse_full", "delta_r2", f.alias("f_stat"), f_tail(f, (F.col("n") - 3).cast("double")).alias("p_value"), "coef", F.col("ryx").alias("pearson_r"))


def contemporaneous(rows: DataFrame, keys: list[str], least_variance: float = 1e-6) -> DataFrame:
    """The ablation without a lag: y on x against the mean alone."""
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("c"))
    m = m.where((F.col("vy") >= least_variance) & (F.col("vx") >= least_variance) & (F.col("n") > 2)).withColumn("delta_r2", F.col("c") * F.col("c") / (F.col("vy") * F.col("vx"))).where("delta_r2 < 1 - 1e-12")
    f = F.col("delta_r2") / (1 - F.col("delta_r2")) * (F.col("n") - 2)
    return m.select(*keys, "n", "delta_r2", f.alias("f_stat"), f_tail(f, (F.col("n") - 2).cast("double")).alias("p_value"))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], out: str = "p_adj") -> DataFrame:
    """Step-up adjusted p-values within groups (all rows if by is empty); tied p share their largest rank, and rows without p go.

    Counts of equal p come first; ranks and minima then run along ranges of distinct p, so that one large group is many tasks.
    """
    kinds = counts_below(df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_k")), by, p, "_k")
    kinds = least_from_here(kinds, by, p, F.col(p) * F.col("_all") / (F.col("_below") + F.col("_k")))
    return df.join(kinds.select(*by, p, F.least("_least", F.lit(1.0)).alias(out)), [*by, p])


def score_edges(edges: DataFrame, reference: float = 50, alpha: float = 0.1, least_effect: float = 0.02, least_score: float = 0.3) -> DataFrame:
    """Adjusted p, composite score, and the soft and hard keep flags; the edges are written once, as ranking reads them twice."""
    edges = written(edges, "edges")
    adjusted = benjamini_hochberg(edges, "p_value", [])
    scored = adjusted.withColumn("composite", composite_score(F.col("p_adj"), F.col("delta_r2"), F.col("n"), reference, alpha, least_effect))
    return scored.withColumn("is_causal", F.col("composite") >= least_score).withColumn("is_hard", (F.col("p_adj") < alpha) & (F.col("delta_r2") > least_effect))


def series(values: DataFrame, key: str, name: str) -> DataFrame:
    """(key, branch, name): each feature's values of a branch as an array by bin, null where a bin has none."""
    listed = values.groupBy(F.col("feature_id").alias(key), "branch").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("_m"))
    return listed.select(key, "branch", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_m"))), lambda b: F.element_at("_m", b)).alias(name))


def local_lag_tests(factor: DataFrame, peak: DataFrame, edges: DataFrame, most_lag: int, rows: int = 12) -> DataFrame:
    """Correlations near each target bin at each lag.

    factor and peak are (feature_id, branch, bin, value); edges (tf, peak_id). For a target bin b and lag k, the pairs
    (x at t - k, y at t) of the branch are ranked by |t - b|, earlier first, and the nearest `rows` make the test.
    The windows of target bins depend on a branch's bins only and are made once.
    """
    bins = peak.select("branch", "bin").distinct()
    lags = bins.select("branch", F.col("bin").alias("t")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most_lag))))
    known = factor.select("branch", F.col("bin").alias("s")).distinct()
    pairs = lags.withColumn("s", F.col("t") - F.col("k")).join(F.broadcast(known), ["branch", "s"])
    first = bins.groupBy("branch").agg(F.min("bin").alias("_first"))
    targets = bins.join(F.broadcast(first), "branch")
    near = targets.join(pairs, "branch").where(F.col("k") <= F.col("bin") - F.col("_first"))
    order = Window.partitionBy("branch", "bin", "k").orderBy(F.abs(F.col("t") - F.col("bin")), "t")
    near = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rows).select("branch", "bin", "k", "t", "s")
    xs, ys = series(factor, "tf", "xs"), series(peak, "peak_id", "ys")
    # one row an edge and branch with both series meets the windows; its tests stay in its task
    both = edges.join(xs, "tf").join(ys, ["peak_id", "branch"]).repartition(shuffle_parts(edges.sparkSession), "tf", "peak_id", "branch")
    both = both.join(F.broadcast(near), "branch").select("tf", "peak_id", "branch", "bin", "k", F.get("xs", F.col("s")).alias("x"), F.get("ys", F.col("t")).alias("y")).where("x is not null and y is not null")
    m = both.groupBy("tf", "peak_id", "branch", "bin", "k").agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    ok = (F.col("n") >= 3) & (F.col("vx") >= 1e-12) & (F.col("vy") > 1e-15)
    r = F.when(ok, F.col("c") / F.sqrt(F.when(ok, F.col("vx") * F.col("vy"))))
    m = m.withColumn("r", F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    weight = F.when(ok, F.col("c") / F.when(ok, F.col("vx")))
    return m.withColumn("p_value", F.when(ok, pearson_tail(F.col("r"), F.col("n").cast("double")))).withColumn("weight", weight).withColumn("contribution", F.abs(weight) * F.sqrt("vx"))


def local_lag_routes(tests: DataFrame, alpha: float, least_contribution: float = 0.0) -> DataFrame:
    """The first lag that passes for each target bin, or status no_supported_lag, with counts up to where the search stopped."""
    passes = (F.col("p_value") <= alpha) & (F.col("contribution") >= least_contribution)
    keys = ["tf", "peak_id", "branch", "bin"]
    flagged = tests.withColumn("_hit", F.coalesce(passes, F.lit(False))).withColumn("selected_lag", F.min(F.when(F.col("_hit"), F.col("k"))).over(Window.partitionBy(*keys)))
    tried = F.col("k") <= F.coalesce("selected_lag", F.lit(1 << 30))
    best = flagged.groupBy(*keys).agg(
        F.min("selected_lag").alias("selected_lag"), F.min_by(F.struct("weight", "p_value", "contribution"), F.when(F.col("_hit"), F.col("k"))).alias("_best"),
        F.count(F.when(tried, 1)).alias("n_lag_attempts"), F.count(F.when(tried, F.col("p_value"))).alias("n_stat_tests"),
    )
    supported = F.col("selected_lag").isNotNull()
    return best.select(
        *keys, F.when(supported, "supported").otherwise("no_supported_lag").alias("status"), "selected_lag", F.when(supported, F.col("bin") - F.col("selected_lag")).otherwise(-1).alias("source_bin"),
        F.col("_best.weight").alias("weight"), F.col("_best.p_value").alias("p_value"), F.col("_best.contribution").alias("contribution"), "n_lag_attempts", "n_stat_tests",
    )


def edge_summary(routes: DataFrame) -> DataFrame:
    """Each edge over its supported bins: mean weight and contribution, largest p, range of lags."""
    return routes.where("status = 'supported'").groupBy("tf", "peak_id").agg(
        F.count("*").alias("n_bins"), F.avg("weight").alias("weight"), F.max("p_value").alias("p_value"), F.avg("contribution").alias("contribution"), F.min("selected_lag").alias("min_lag"), F.max("selected_lag").alias("max_lag")
    )


def minimum_supported_lag(routes: DataFrame) -> DataFrame:
    return routes.where("status = 'supported'").groupBy("peak_id", "branch", "bin").agg(F.min("selected_lag").alias("min_lag"))


def adjacent_changes(predictions: DataFrame, keys: list[str], value: Column | str = "value", supported: str = "supported") -> DataFrame:
    """Absolute change from the bin before, where both bins follow on each other and both are supported."""
    order = Window.partitionBy(*keys).orderBy("bin")
    value = F.col(value) if isinstance(value, str) else value
    both = (F.lag("bin").over(order) == F.col("bin") - 1) & F.col(supported) & F.lag(supported).over(order)
    return predictions.withColumn("change", F.when(both, F.abs(value - F.lag(value).over(order))))


def frozen_weights(changes: DataFrame, target: list[str], inputs: list[str]) -> DataFrame:
    """Input weights: mean absolute adjacent change over the target's sum of them; all zero gives no_information."""
    score = changes.groupBy(*target, *inputs).agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("score"))
    total = F.sum("score").over(Window.partitionBy(*target))
    return score.withColumn("alpha", F.when(total > 0, F.col("score") / total)).withColumn("status", F.when(total > 0, "ok").otherwise("no_information"))


def fit_metrics(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE and R2 of predictions; R2 is null where y does not vary."""
    m = fitted.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("y") - F.col("y_hat"), 2)).alias("_mse"), F.var_pop("y").alias("_v"))
    return m.select(*keys, "n", F.sqrt("_mse").alias("rmse"), F.when(F.col("_v") > 1e-15, 1 - F.col("_mse") / F.col("_v")).alias("r2"))
