"""Endpoints of simulated interventions: status, pooling over contexts, accessibility merges, pathways and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.stats import clip


def endpoint_status(control: Column, perturbed: Column, available: Column, r2: Column | None = None, least_r2: float = 0.0) -> Column:
    low = F.lit(False) if r2 is None else F.coalesce(r2 < least_r2, F.lit(True))
    return F.when(~available, "unavailable").when(low, "quality_filtered").when(control <= 0, "zero_control").when(perturbed <= 0, "zero_perturbed_floor").otherwise("ok")


def visible_effects(endpoints: DataFrame, threshold: float) -> DataFrame:
    """Selected, indirect, available effects above the threshold (0 still leaves out exact zeros)."""
    return endpoints.where((F.col("status") == "ok") & F.col("selected") & ~F.col("direct_target") & (F.abs("delta") > max(0.0, threshold)))


def pooled_fold_change(endpoints: DataFrame, contexts: DataFrame, least_delta: float = 0.0) -> DataFrame:
    """log2 of the cell-weighted perturbed over control means of each (target_gene, affected_gene).

    Only contexts whose endpoint is ok count, on both sides alike. effect_scope is full, partial or unavailable;
    excluded lists the other contexts with their reasons as JSON. Effects below max(least_delta, 1e-6) go, undefined ones stay.
    """
    pairs = endpoints.select("target_gene", "affected_gene").distinct()
    full = pairs.crossJoin(F.broadcast(contexts)).join(endpoints, ["source_context", "target_gene", "affected_gene"], "left")
    used = F.coalesce(F.col("status") == "ok", F.lit(False))
    reason = F.when(~used, F.coalesce("status", F.lit("endpoint_unavailable")))
    sums = full.groupBy("target_gene", "affected_gene").agg(
        F.sum(F.when(used, F.col("n_cells") * F.col("control_mean"))).alias("_c"), F.sum(F.when(used, F.col("n_cells") * F.col("perturbed_mean"))).alias("_p"),
        F.coalesce(F.sum(F.when(used, F.col("n_cells"))), F.lit(0)).alias("used_cells"), F.sum("n_cells").alias("all_cells"),
        F.sort_array(F.collect_list(F.when(~used, F.struct("source_context", reason.alias("reason"))))).alias("_x"),
    )
    fold = F.when((F.col("_c") > 0) & (F.col("_p") > 0), F.log2(F.when(F.col("_p") > 0, F.col("_p")) / F.when(F.col("_c") > 0, F.col("_c"))))
    scope = F.when(F.col("used_cells") == 0, "unavailable").when(F.col("used_cells") == F.col("all_cells"), "full").otherwise("partial")
    out = sums.select(
        "target_gene", "affected_gene", (F.col("_c") / F.when(F.col("used_cells") > 0, F.col("used_cells"))).alias("control_mean"), (F.col("_p") / F.when(F.col("used_cells") > 0, F.col("used_cells"))).alias("perturbed_mean"),
        fold.alias("log2_fold"), clip(fold, -10, 10).alias("shown"), "used_cells", (F.col("used_cells") / F.col("all_cells")).alias("cell_fraction"), scope.alias("effect_scope"),
        F.to_json(F.map_from_entries("_x")).alias("excluded"),
    )
    return out.where(F.col("shown").isNull() | (F.abs("shown") >= max(least_delta, 1e-6)))


def complete_fold_change(endpoints: DataFrame, contexts: DataFrame) -> DataFrame:
    """Log-space merge over all contexts: those without a perturbed mean keep their control mean; clipped to +-10."""
    pairs = endpoints.select("target_gene", "affected_gene").distinct()
    base = endpoints.groupBy("source_context", "affected_gene").agg(F.max("control_mean").alias("base"))
    full = pairs.crossJoin(F.broadcast(contexts)).join(base, ["source_context", "affected_gene"]).join(endpoints.select("source_context", "target_gene", "affected_gene", "perturbed_mean", "status"), ["source_context", "target_gene", "affected_gene"], "left")
    after = F.when(F.col("status") == "ok", F.col("perturbed_mean")).otherwise(F.col("base"))
    sums = full.groupBy("target_gene", "affected_gene").agg(F.sum(F.col("n_cells") * F.col("base")).alias("_c"), F.sum(F.col("n_cells") * after).alias("_p"))
    ok = (F.col("_c") > 0) & (F.col("_p") > 0)
    return sums.select("target_gene", "affected_gene", clip(F.when(ok, F.log2(F.when(ok, F.col("_p") / F.col("_c")))), -10, 10).alias("log2_fold"))


def weighted_deltas(effects: DataFrame, keys: list[str], weight: str, total: float | Column) -> DataFrame:
    """Weighted signed and absolute mean delta by keys, over the whole weight."""
    total = total if isinstance(total, Column) else F.lit(total)
    return effects.groupBy(*keys).agg((F.sum(F.col(weight) * F.col("delta")) / total).alias("mean_delta"), (F.sum(F.col(weight) * F.abs("delta")) / total).alias("mean_abs_delta"), F.count("*").alias("n_contexts"))


def merge_accessibility(changes: DataFrame, z: float = 2.0) -> DataFrame:
    """Cell-weighted accessibility changes of a (target_gene, peak_id); one unavailable context makes the row unavailable."""
    sums = changes.groupBy("target_gene", "peak_id").agg(
        F.bool_or(F.col("status") == "unavailable").alias("_u"), F.sum("n_cells").alias("_n"), *(F.sum(F.col("n_cells") * x).alias(n) for x, n in ((F.col("delta"), "_d"), (F.abs("delta"), "_a"), (F.col("z_score"), "_z")))
    )
    mean = lambda c: F.when(~F.col("_u"), F.col(c) / F.col("_n"))
    return sums.select("target_gene", "peak_id", mean("_d").alias("delta"), mean("_a").alias("abs_delta"), mean("_z").alias("z_score"), F.when(F.col("_u"), "unavailable").otherwise("ok").alias("status"), F.when(~F.col("_u"), F.abs(F.col("_z") / F.col("_n")) >= z).alias("significant"))


def z_scores(deltas: DataFrame, control: DataFrame) -> DataFrame:
    """Mean change of a peak over bins by the population deviation of its control bins; 0 where that is below 1e-10."""
    sd = control.groupBy("peak_id").agg(F.stddev_pop("value").alias("_sd"))
    mean = deltas.groupBy("peak_id").agg(F.avg("delta").alias("delta"))
    return mean.join(sd, "peak_id").select("peak_id", "delta", F.when(F.col("_sd") > 1e-10, F.col("delta") / F.col("_sd")).otherwise(0.0).alias("z_score"))


def strongest_change(changes: DataFrame) -> DataFrame:
    """The change of largest size of each peak over interventions; ties to the smaller target."""
    return changes.groupBy("peak_id").agg(F.min_by(F.struct("target_gene", "delta"), F.struct(-F.abs("delta"), "target_gene")).alias("m")).select("peak_id", "m.target_gene", "m.delta")


def pathways(factor: DataFrame, peak: DataFrame, endpoints: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """Routes factor -> peak -> gene: a factor's contribution at a bin, the peak's on the gene a bin later, and a usable endpoint.

    factor(target_gene, source_context, branch, bin, source_bin, tf, peak_id, delta, method), peak(target_gene, source_context,
    branch, bin, gene, peak_id, delta, method), endpoints(target_gene, source_context, gene, effect). Zero, NaN and infinite
    contributions and effects make no route. clips(source_context, target_gene, peak_id, bin, clip) is optional.
    """
    keys = ["source_context", "target_gene", "branch"]

    def real(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) != 0)

    f = factor.where(real("delta")).select(*keys, "bin", (F.col("bin") - F.col("source_bin")).alias("lag"), "tf", "peak_id", F.col("delta").alias("tf_delta"), F.col("method").alias("tf_method"))
    p = peak.where(real("delta")).select(*keys, (F.col("bin") - 1).alias("bin"), "gene", "peak_id", F.col("delta").alias("peak_delta"), F.col("method").alias("peak_method"))
    e = endpoints.where(real("effect")).select("source_context", "target_gene", "gene", "effect")
    events = f.join(p, [*keys, "bin", "peak_id"]).join(e, ["source_context", "target_gene", "gene"])
    if clips is None:
        events = events.withColumn("clip", F.lit("none"))
    else:
        events = events.join(clips, ["source_context", "target_gene", "peak_id", "bin"], "left").withColumn("clip", F.coalesce("clip", F.lit("none")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return events.groupBy(*keys, "tf", "peak_id", "gene", "lag").agg(
        F.count("*").alias("event_count"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("tf_delta").alias("tf_sum"), F.sum("peak_delta").alias("peak_sum"),
        F.max("effect").alias("effect"), listed("tf_method").alias("tf_methods"), listed("peak_method").alias("peak_methods"), listed("clip").alias("clips"),
    )


def heterogeneity(effects: DataFrame) -> DataFrame:
    """Genes ranked by how their effects differ between clusters: coverage, range and deviation, sign switches, balance."""
    n = effects.select("cluster").distinct().agg(F.count("*").alias("_k"))
    g = effects.groupBy("gene").agg(F.countDistinct("cluster").alias("n"), (F.max("delta") - F.min("delta")).alias("range"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"), F.sum((F.col("delta") > 0).cast("int")).alias("up"), F.sum((F.col("delta") < 0).cast("int")).alias("down"))
    switch = (F.col("up") > 0) & (F.col("down") > 0)
    balance = F.when(F.col("up") + F.col("down") > 0, F.least("up", "down") / F.when(F.col("up") + F.col("down") > 0, F.greatest("up", "down"))).otherwise(0.0)
    score = F.col("n") / F.col("_k") * (F.col("range") + F.col("sd")) * F.when(switch, 1.25).otherwise(1.0) * (1 + balance)
    return g.crossJoin(F.broadcast(n)).select("gene", "n", switch.alias("sign_switch"), score.alias("score"))


def joint_contributions(up: DataFrame, down: DataFrame, top_tf: int, top_gene: int) -> DataFrame:
    """Factor -> gene hierarchies: joint sqrt(|up| * down) over peaks, the top factors by their sum and each one's top genes."""
    joint = up.join(down, ["cluster", "peak_id"]).groupBy("cluster", "tf", "gene").agg(F.sum(F.sqrt(F.abs("up") * F.abs("down"))).alias("joint"))
    tf = joint.groupBy("cluster", "tf").agg(F.sum("joint").alias("tf_joint"))
    tf = tf.withColumn("tf_rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("tf_joint", 6)), "tf"))).where(F.col("tf_rank") <= top_tf)
    genes = joint.join(tf, ["cluster", "tf"]).withColumn("gene_rank", F.row_number().over(Window.partitionBy("cluster", "tf").orderBy(F.desc(F.round("joint", 6)), "gene")))
    return genes.where(F.col("gene_rank") <= top_gene).select("cluster", "tf", "gene", "tf_rank", "gene_rank", "joint")


def onsets(series: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Runs of consecutive bins above the threshold: start, end and peak value."""
    order = Window.partitionBy(*keys).orderBy("bin")
    new = F.when((F.lag("bin").over(order) == F.col("bin") - 1), 0).otherwise(1)
    high = series.where(F.col("value") > threshold).withColumn("_new", new)
    return high.withColumn("run", F.sum("_new").over(order)).groupBy(*keys, "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.max("value").alias("peak"))


def reconstruct_cells(direct: DataFrame, membership: DataFrame, deltas: DataFrame) -> DataFrame:
    """Cell values after a bin-level change on the twice-logged scale, decoded to counts per 10k.

    direct(cell_id, feature_id, value): log1p of the cell's CP10k; membership(cell_id, branch, bin, w); deltas(branch, bin, feature_id, delta).
    """
    moved = membership.join(deltas, ["branch", "bin"]).groupBy("cell_id", "feature_id").agg(F.sum(F.col("w") * F.col("delta")).alias("_d"))
    after = F.greatest(F.expm1(F.log1p("value") + F.coalesce("_d", F.lit(0.0))), F.lit(0.0))
    return direct.join(moved, ["cell_id", "feature_id"], "left").select("cell_id", "feature_id", F.expm1("value").alias("before"), F.expm1(after).alias("after"))


def knock_out(entries: DataFrame, targets: DataFrame, strength: float) -> DataFrame:
    """Logged CP10k with the targets' counts scaled by 1 - strength."""
    marked = entries.join(F.broadcast(targets.select("feature_id").withColumn("_t", F.lit(True))), "feature_id", "left")
    return marked.select("cell_id", "feature_id", F.when(F.col("_t"), F.log1p(F.expm1("value") * (1 - strength))).otherwise(F.col("value")).alias("value"))


def bed_rows(changes: DataFrame) -> DataFrame:
    """BED fields of finite changes: score is 1000 |delta| cut to 0..1000."""
    return changes.where(F.col("delta").isNotNull() & ~F.isnan("delta") & (F.abs("delta") < float("inf"))).select("chrom", "start", "end", "name", F.least(F.greatest(F.round(F.abs("delta") * 1000), F.lit(0)), F.lit(1000)).cast("int").alias("score"))


def peak_knock_out(entries: DataFrame, peak_id: int, strength: float, relative: bool = True, cap: float = 1.0) -> DataFrame:
    """Accessibility with one peak lowered: by a share of its value, or by an absolute amount, within 0..cap."""
    after = F.col("value") * (1 - strength) if relative else F.col("value") - strength
    return entries.withColumn("value", F.when(F.col("feature_id") == peak_id, F.least(F.greatest(after, F.lit(0.0)), F.lit(cap))).otherwise(F.col("value")))


def counterfactual_cells(cells: DataFrame, membership: DataFrame, control: DataFrame, perturbed: DataFrame, strict: bool = True) -> DataFrame:
    """Cell states moved by their bins' change: value + sum of w (perturbed - control); a negative state is an error if strict, else 0."""
    moved = control.join(perturbed.withColumnRenamed("value", "_after"), ["branch", "bin", "feature_id"]).select("branch", "bin", "feature_id", (F.col("_after") - F.col("value")).alias("_d"))
    shift = membership.join(moved, ["branch", "bin"]).groupBy("cell_id", "feature_id").agg(F.sum(F.col("w") * F.col("_d")).alias("_s"))
    after = F.col("value") + F.coalesce("_s", F.lit(0.0))
    low = F.raise_error(F.lit("negative counterfactual state")).cast("double") if strict else F.lit(0.0)
    return cells.join(shift, ["cell_id", "feature_id"], "left").select("cell_id", "feature_id", F.when(after < -1e-12, low).otherwise(F.greatest(after, F.lit(0.0))).alias("value"))
