"""Bounded response models of targets, fitted per group, and forward propagation of interventions.

A target's single models map one input to the target within its bounds: saturating (softsign), network (one
hidden layer) or spline (three inner knots), all fitted by damped Gauss-Newton from fixed starts. Groups are
one target each and hold a row per bin and input, so a group is as small as the number of bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import written

MODEL = "target_id long, input_id long, family string, status string, params array<double>, low double, high double, rmse double, r2 double, n long, low_x double, high_x double"


def output_bounds(y: str = "y") -> tuple[Column, Column]:
    """Bounds of a target: 0 and its largest value plus a quarter of its range."""
    return F.lit(0.0), F.max(y) + 0.25 * (F.max(y) - F.min(y))


def basis(x: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Truncated power basis of a spline with three knots: 1, x and hinge cubes."""
    knots = params[:3]
    return np.stack([np.ones_like(x), x, *(np.maximum(x - k, 0) ** 3 for k in knots)], axis=1)


def response(family: str, p: np.ndarray, x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Values of a single model, cut to its bounds."""
    if family == "saturation":
        z = (x - p[2]) / np.exp(p[3])
        out = p[0] + p[1] * z / (1 + np.abs(z))
    elif family == "network":
        h = np.tanh(np.outer(x, p[0:4]) + p[4:8])
        out = low + (high - low) / (1 + np.exp(-np.clip(h @ p[8:12] + p[12], -30, 30)))
    elif family == "spline":
        out = low + (high - low) / (1 + np.exp(-np.clip(basis(x, p) @ p[3:8], -30, 30)))
    else:
        out = np.full_like(x, p[0])
    return np.clip(out, low, high)


def _starts(family: str, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    mid, span, rise = float(np.median(x)), float(np.ptp(x)) or 1.0, float(np.ptp(y)) or 1.0
    if family == "saturation":
        sign = np.sign(np.cov(x, y)[0, 1]) or 1.0
        return [np.array([y.mean(), sign * rise, c, np.log(span * s)]) for c, s in ((mid, 0.5), (float(np.quantile(x, 0.25)), 0.25), (float(np.quantile(x, 0.75)), 1.0))]
    if family == "network":
        rng = np.random.Generator(np.random.PCG64(42))
        w = rng.normal(0, 1, 4) / span
        return [np.concatenate([w, -w * mid, rng.normal(0, 0.5, 4), [0.0]])]
    return [np.concatenate([np.quantile(x, [0.25, 0.5, 0.75]), np.zeros(5)])]


def _free(family: str, p: np.ndarray) -> np.ndarray:
    """Which parameters move: a spline's knots stay."""
    out = np.ones(len(p), bool)
    if family == "spline":
        out[:3] = False
    return out


def fit_single(x: np.ndarray, y: np.ndarray, family: str, low: float, high: float, rounds: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, str]:
    """Least squares by damped Gauss-Newton with numeric slopes; the loss never rises from its start."""
    if np.ptp(x) < 1e-12 or np.ptp(y) < 1e-12:
        return np.array([float(y.mean())]), "constant_input" if np.ptp(x) < 1e-12 else "constant_target"
    best, best_loss, status = None, np.inf, "budget_exhausted"
    for p in _starts(family, x, y):
        free = np.flatnonzero(_free(family, p))
        loss = float(((response(family, p, x, low, high) - y) ** 2).sum() + ridge * (p[free] ** 2).sum())
        damp, done = 1e-2, False
        for _ in range(rounds):
            r = response(family, p, x, low, high) - y
            jac = np.empty((len(x), len(free)))
            for c, k in enumerate(free):
                step = 1e-6 * max(1.0, abs(p[k]))
                q = p.copy()
                q[k] += step
                jac[:, c] = (response(family, q, x, low, high) - y - r) / step
            a, g = jac.T @ jac + ridge * np.eye(len(free)), jac.T @ r + ridge * p[free]
            improved = False
            for _ in range(8):
                q = p.copy()
                q[free] -= np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-9), g)
                if family == "saturation":
                    q[3] = np.clip(q[3], -20, 20)
                new = float(((response(family, q, x, low, high) - y) ** 2).sum() + ridge * (q[free] ** 2).sum())
                if np.isfinite(new) and new < loss:
                    improved, done = True, loss - new < 1e-9 * max(loss, 1e-12)
                    p, loss, damp = q, new, damp / 3
                    break
                damp *= 4
            if not improved or done:
                done = True
                break
        if loss < best_loss:
            best, best_loss, status = p, loss, "ok" if done else "budget_exhausted"
    return best, status


def fit_responses(rows: DataFrame, family: str = "saturation") -> DataFrame:
    """Single models of rows(target_id, input_id, x, y), one per pair, bounded by the target's own range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        low, high = 0.0, float(y.max() + 0.25 * np.ptp(y))
        p, status = fit_single(x, y, family, low, high)
        kind = "constant" if status.startswith("constant") else family
        e = response(kind, p, x, low, high) - y
        v = float(y.var())
        r2 = 1 - float((e**2).mean()) / v if v > 1e-15 else None
        return pd.DataFrame([[pdf["target_id"].iloc[0], pdf["input_id"].iloc[0], kind, status, list(map(float, p)), low, high, float(np.sqrt((e**2).mean())), r2, len(x), float(x.min()), float(x.max())]], columns=[c.split()[0] for c in MODEL.split(", ")])

    return rows.groupBy("target_id", "input_id").applyInPandas(run, MODEL)


def prune_responses(models: DataFrame, least_r2: float) -> DataFrame:
    """Adds excluded: the reason of models that may not be used, null for the others."""
    reason = F.when(F.col("status").startswith("constant"), F.col("status")).when(F.col("r2").isNull() | (F.col("r2") < least_r2), "low_single_r2")
    return models.withColumn("excluded", reason)


def model_value(family: Column, x: Column, params: Column, low: Column, high: Column) -> Column:
    """A single's value as a column expression, by its family; a family that is none of them is an error."""
    p = lambda k: F.get(params, F.lit(k))
    total = lambda terms: F.aggregate(F.array(*terms), F.lit(0.0), lambda a, t: a + t)
    squash = lambda z: low + (high - low) / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    z = (x - p(2)) / F.exp(p(3))
    hinges = [p(3), p(4) * x, *(p(5 + k) * F.pow(F.greatest(x - p(k), F.lit(0.0)), F.lit(3.0)) for k in range(3))]
    units = [p(8 + k) * F.tanh(x * p(k) + p(4 + k)) for k in range(4)]
    value = (
        F.when(family == "constant", p(0)).when(family == "saturation", p(0) + p(1) * z / (1 + F.abs(z))).when(family == "spline", squash(total(hinges))).when(family == "network", squash(total([*units, p(12)])))
        .otherwise(F.raise_error(F.concat(F.lit("unknown family "), F.coalesce(family, F.lit("null")))).cast("double"))
    )
    return F.least(F.greatest(value, low), high)


def _values() -> tuple[Column, Column]:
    """Values of a row's model at x_old and x_new."""
    return tuple(model_value(F.col("family"), F.col(c), F.col("params"), F.col("low"), F.col("high")) for c in ("x_old", "x_new"))


def predict_deltas(models: DataFrame, weights: DataFrame, states: DataFrame) -> DataFrame:
    """Change of each target from its inputs' states(input_id, bin, x_old, x_new), singles of any family weighted by weights(target_id, input_id, alpha).

    Both sums are cut to the target's bounds before the difference.
    """
    joined = models.join(weights, ["target_id", "input_id"]).join(states, "input_id")
    old, new = _values()
    sums = joined.groupBy("target_id", "bin").agg(F.sum(F.col("alpha") * old).alias("_o"), F.sum(F.col("alpha") * new).alias("_n"), F.max("low").alias("_l"), F.max("high").alias("_h"))
    cut = lambda c: F.least(F.greatest(F.col(c), F.col("_l")), F.col("_h"))
    return sums.select("target_id", "bin", (cut("_n") - cut("_o")).alias("delta"))


def contributions(models: DataFrame, weights: DataFrame, states: DataFrame) -> DataFrame:
    """Each input's own part alpha (f(x_new) - f(x_old)) of a target's change."""
    joined = models.join(weights, ["target_id", "input_id"]).join(states, "input_id")
    old, new = _values()
    return joined.select("target_id", "input_id", "bin", (F.col("alpha") * (new - old)).alias("delta"))


def propagate(state: DataFrame, relations: DataFrame, interventions: DataFrame) -> DataFrame:
    """Bin-by-bin propagation of knock-outs; each bin and layer is a join of the relations with the states that they read.

    state(context, branch, bin, layer, feature_id, value) is control; layers are gene and peak. relations(layer, target_id, input_id,
    lag, alpha, family, params, low, high): a gene reads peaks at an earlier bin, a peak reads genes at the same or an earlier one.
    interventions(intervention, context, feature_id, strength) scale genes. Genes of a bin come before its peaks. A target whose
    inputs all lie before the branch's first bin keeps its control value with status no_history. A target with an input that the
    state lacks, or that is itself unavailable, is unavailable: perturbed is null, and origins names the inputs that are missing.
    Each other target moves by the difference of its weighted models and stays within its bounds.

    Returns context, intervention, branch, bin, layer, feature_id, control, perturbed, status and origins. A step's result is written,
    and the next one reads what lies within the largest lag; keys are context, intervention, branch and feature, so work spreads over all of them.
    """
    keys = ["context", "intervention", "branch"]
    name = lambda layer, feature: F.concat(layer, F.lit(" "), feature.cast("string"))
    lost = F.col("value").isNull() | F.isnan("value")
    asked = interventions.groupBy("context", "intervention", F.col("feature_id")).agg(F.max("strength").alias("strength")).withColumn("layer", F.lit("gene"))
    control = state.join(interventions.select("context", "intervention").distinct(), "context").join(asked, ["context", "intervention", "layer", "feature_id"], "left")
    first = F.min("bin").over(Window.partitionBy("context", "branch"))
    relations = written(relations, "relations")
    modelled = relations.select("layer", F.col("target_id").alias("feature_id")).distinct().withColumn("modelled", F.lit(True))
    known = control.withColumn("first", first).select(*keys, "bin", "first", "layer", "feature_id", F.col("value").alias("control"), "strength", lost.alias("lost"))
    known = written(known.join(modelled, ["layer", "feature_id"], "left"), "control", ("bin", "layer"))
    # what each target reads, once for all bins; a step opens its own folder
    reads = known.where("strength is null and not lost").join(relations.withColumnRenamed("target_id", "feature_id"), ["layer", "feature_id"]).withColumn("from", F.col("bin") - F.col("lag"))
    reads = written(reads.where(F.col("from") >= F.col("first")).select(*keys, "bin", "layer", "feature_id", "from", "input_id", "alpha", "family", "params", "low", "high"), "reads", ("bin", "layer"))
    origin = F.when(F.col("lost"), F.array(name(F.col("layer"), F.col("feature_id")))).otherwise(F.array().cast("array<string>"))
    steps = {(r["bin"], r["layer"]) for r in known.select("bin", "layer").distinct().collect()}
    reach = int(relations.agg(F.max("lag")).first()[0] or 0)
    past: dict[tuple[int, str], DataFrame] = {}
    out = None
    # expressions name columns only, so they are made once for all steps
    old, new = _values()
    missing = {side: F.when(F.col("of").isNull(), F.array(name(F.lit(side), F.col("input_id")))).otherwise(F.col("of")) for side in ("gene", "peak")}
    fit = F.size("missing") == 0
    sums = [
        F.count("*").alias("n"), F.sum(F.when(fit, F.col("alpha") * old)).alias("old"), F.sum(F.when(fit, F.col("alpha") * new)).alias("new"), F.coalesce(F.bool_and(F.col("x_old") == F.col("x_new")), F.lit(False)).alias("same"),
        F.max("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("of"),
    ]
    nothing = [F.lit(0).alias("n"), *(F.lit(None).cast(t).alias(c) for c, t in (("old", "double"), ("new", "double"), ("same", "boolean"), ("low", "double"), ("high", "double"), ("of", "array<string>")))]
    cut = lambda c: F.least(F.greatest(F.col(c), F.col("low")), F.col("high"))
    target = F.least(F.greatest(F.col("control") + cut("new") - cut("old"), F.col("low")), F.greatest("high", "control"))
    direct = F.col("strength").isNotNull()
    none = F.coalesce("n", F.lit(0)) == 0
    gone = F.col("lost") | (~direct & F.coalesce(F.size("of") > 0, F.lit(False)))
    status = F.when(F.col("lost"), "unavailable").when(direct, "direct").when(gone, "unavailable").when(none & F.col("modelled"), "no_history").otherwise("ok")
    value = F.when(gone, F.lit(None).cast("double")).when(direct, F.col("control") * (1 - F.col("strength"))).when(none | F.col("same"), F.col("control")).otherwise(target)
    listed = F.when(F.col("lost"), origin).when(direct, F.array().cast("array<string>")).otherwise(F.coalesce("of", F.array().cast("array<string>")))
    result = [*(F.col(c) for c in (*keys, "bin", "layer", "feature_id", "control")), value.alias("perturbed"), status.alias("status"), listed.alias("origin_list")]
    states = [*(F.col(c) for c in keys), F.col("bin").alias("from"), F.col("feature_id").alias("input_id"), F.col("control").alias("x_old"), F.col("perturbed").alias("x_new"), F.col("origin_list").alias("of")]
    for bin_, layer in sorted(steps, key=lambda s: (s[0], s[1] != "gene")):
        here = known.where((F.col("bin") == bin_) & (F.col("layer") == layer))
        source = "peak" if layer == "gene" else "gene"
        seen = None
        for (b, side), frame in past.items():
            if side == source and b >= bin_ - reach:
                part = frame.select(*states)
                seen = part if seen is None else seen.unionByName(part)
        if seen is None:
            moved = here.select(*keys, "feature_id", *nothing)
        else:
            both = reads.where((F.col("bin") == bin_) & (F.col("layer") == layer)).join(seen, [*keys, "from", "input_id"], "left")
            moved = both.withColumn("missing", missing[source]).groupBy(*keys, "feature_id").agg(*sums)
        step = written(here.join(moved, [*keys, "feature_id"], "left").select(*result), "propagated")
        past[bin_, layer] = step
        out = step if out is None else out.unionByName(step)
    if out is None:
        out = known.limit(0).select(*keys, "bin", "layer", "feature_id", "control", F.col("control").alias("perturbed"), F.lit("").alias("status"), F.array().cast("array<string>").alias("origin_list"))
    return out.withColumn("origins", F.when(F.size("origin_list") > 0, F.array_join("origin_list", ", "))).drop("origin_list")
