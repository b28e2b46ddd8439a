"""Tables linked by identifiers: cells and their labels, genes as people read them, requests, routes and the reports' joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import cluster_id, strip_version
from strandline.operators.ordered import counts_below

# Columns that may hold an effect, the first of them counts; words that stand where a gene id would.
EFFECT_COLUMNS = ("endpoint_delta_rna_log2fc", "delta_rna_log2fc", "delta_log1p_rna_log1p_cp10k", "delta_rna_signed", "delta_rna")
NO_GENES = ("peak", "joint_vector", "unknown")


def refuse(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """rows, or an error with the message where bad holds; a condition on rows, which no plan prunes as it would an unused column."""
    return rows.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def once(rows: DataFrame, key: str) -> DataFrame:
    """rows with an error where a key comes twice."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return refuse(counted, F.col("_n") > 1, F.concat(F.lit(f"repeated {key} "), F.col(key).cast("string"))).drop("_n")


def align_cells(model: DataFrame, reference: DataFrame) -> DataFrame:
    """model's rows of the reference's cells; a reference cell that the model lacks, or a repeated one, is an error."""
    known = once(model, "cell_id").withColumn("_here", F.lit(True))
    joined = once(reference.select("cell_id"), "cell_id").join(known, "cell_id", "left")
    missing = F.concat(F.lit("model lacks reference cell "), F.col("cell_id").cast("string"))
    return refuse(joined, F.col("_here").isNull(), missing).drop("_here")


def attach_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """cells with the columns of labels(cell_id, label, ...); both must hold the same cells once, and no label may be null."""
    left, right = once(cells, "cell_id").withColumn("_l", F.lit(True)), once(labels, "cell_id").withColumn("_r", F.lit(True))
    bad = F.col("_l").isNull() | F.col("_r").isNull() | F.col("label").isNull()
    why = F.concat(F.lit("cells and labels differ, or no label, at "), F.col("cell_id").cast("string"))
    return refuse(left.join(right, "cell_id", "full"), bad, why).drop("_l", "_r")


def ordered_labels(rows: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label, place): a group's distinct labels from 1, as whole numbers where all of them are, else as text."""
    number = F.col(label).try_cast("long")
    kinds = rows.where(F.col(label).isNotNull()).select(by, label).distinct()
    whole = kinds.groupBy(by).agg(F.min(number.isNotNull()).alias("_whole"))
    keyed = kinds.join(whole, by).select(by, F.struct(F.when(F.col("_whole"), number).alias("n"), F.col(label).alias("s")).alias("_key"), F.lit(1).alias("_one"))
    return counts_below(keyed, [by], "_key", "_one").select(by, F.col("_key.s").alias(label), (F.col("_below") + 1).alias("place"))


def numbered_labels(records: DataFrame) -> DataFrame:
    """(id, name, label) of records(id, name): a name of one id is its label, others get _01, _02, ... by id.

    A numbered label that is itself somebody's name takes the id too.
    """
    own = Window.partitionBy("name")
    n = F.count("*").over(own)
    place = F.row_number().over(own.orderBy("id")).cast("string")
    width = F.greatest(F.length(n.cast("string")), F.lit(2))
    numbered = records.select("id", "name").distinct().withColumn("label", F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.lpad(place, width, "0"))))
    taken = records.select(F.col("name").alias("label")).distinct().withColumn("_taken", F.lit(True))
    clash = F.col("_taken").isNotNull() & (F.col("label") != F.col("name"))
    return numbered.join(taken, "label", "left").select("id", "name", F.when(clash, F.concat("label", F.lit("__"), F.col("id").cast("string"))).otherwise(F.col("label")).alias("label"))


def present_genes(rows: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """rows with `column` (ids, comma-joined) as labels, and column_id, column_name and their three JSON lists beside it.

    Nulls and words that stand for no gene stay as they are; an unknown id is an error. Distinct values are looked up once,
    and rows meet them by value.
    """
    held = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    genes = held.where(~(F.col("_v").isin(*NO_GENES) | F.col("_v").startswith("PEAK:")))
    parts = genes.select("_v", F.posexplode(F.split("_v", ",")).alias("_at", "_id")).withColumn("_id", strip_version(F.col("_id")))
    known = numbered_labels(records).select(F.col("id").cast("string").alias("_id"), "name", "label")
    found = refuse(parts.join(known, "_id", "left"), F.col("label").isNull(), F.concat(F.lit("unknown gene id "), F.col("_id")))
    lists = found.groupBy("_v").agg(F.sort_array(F.collect_list(F.struct("_at", "_id", "name", "label"))).alias("_l"))
    shown = lists.select("_v", *(F.col(f"_l.{c}").alias(f"_{n}") for c, n in (("_id", "ids"), ("name", "names"), ("label", "labels"))))
    joined = rows.join(shown, F.col(column) == F.col("_v"), "left")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.col(column))
    extra = {f"{column}_id": text("_ids"), f"{column}_name": text("_names"), f"{column}_ids_json": F.to_json("_ids"), f"{column}_names_json": F.to_json("_names"), f"{column}_display_names_json": F.to_json("_labels"), column: text("_labels")}
    return joined.withColumns(extra).drop("_v", "_ids", "_names", "_labels")


def available_effects(rows: DataFrame, merged: bool = False) -> DataFrame:
    """Adds plot_delta, from the first effect column there is, and plot_available: finite, ok and of a scope that is not unavailable.

    Status and scope count where the columns exist; a null scope is no objection, a null status is one.
    """
    order = (("delta_rna_signed",) if merged else ()) + EFFECT_COLUMNS
    column = next((c for c in order if c in rows.columns), None)
    if column is None:
        raise ValueError(f"no effect column among {', '.join(rows.columns)}")
    delta = F.col(column).cast("double")
    ok = finite(delta)
    if "status" in rows.columns:
        ok = ok & F.coalesce(F.col("status") == "ok", F.lit(False))
    if "aggregation_scope" in rows.columns:
        ok = ok & F.coalesce(F.col("aggregation_scope") != "unavailable", F.lit(True))
    return rows.withColumn("plot_delta", delta).withColumn("plot_available", ok)


def undeclared_changes(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """(target, input) that changed without being declared."""
    return actual.select("target", "input").distinct().join(declared, ["target", "input"], "left_anti")


def require_declared(actual: DataFrame, declared: DataFrame) -> None:
    first = undeclared_changes(actual, declared).limit(10).collect()
    if first:
        raise ValueError(f"changed without being declared: {[tuple(r) for r in first]}")


def request_matches(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request, status, id) of requests(request) under aliases(alias, id): an id itself comes first, then its only alias.

    status is found, ambiguous (an alias of several ids; id is null) or unknown.
    """
    asked = requests.where("request is not null").select("request").distinct()
    ids = aliases.select(F.col("id").alias("request")).distinct().withColumn("_exact", F.lit(True))
    by_alias = aliases.select(F.col("alias").alias("request"), "id").groupBy("request").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    joined = asked.join(ids, "request", "left").join(by_alias, "request", "left")
    one = F.col("_low") == F.col("_high")
    found = F.when(F.col("_exact"), F.col("request")).when(one, F.col("_low"))
    return joined.select("request", F.when(found.isNotNull(), "found").when(F.col("_low").isNotNull(), "ambiguous").otherwise("unknown").alias("status"), found.alias("id"))


def requested_rows(rows: DataFrame, key: str, matches: DataFrame, unknown_fails: bool = False) -> DataFrame:
    """rows whose key was found for a request; an ambiguous one is an error, an unknown one only if asked for."""
    bad = matches.where("status = 'ambiguous'" + (" or status = 'unknown'" if unknown_fails else "")).limit(10).collect()
    if bad:
        raise ValueError(f"requests that name no single id: {[(r['request'], r['status']) for r in bad]}")
    return rows.join(matches.where("status = 'found'").select(F.col("id").alias(key)).distinct(), key, "left_semi")


def reconcile_clusters(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with cluster_7 as 7 where only the latter is among known(cluster); both spellings of one cluster in rows are an error."""
    refs = known.select("cluster").distinct()
    kinds = rows.select("cluster").distinct().withColumn("_short", cluster_id(F.col("cluster")))
    marked = kinds.join(refs.withColumn("_own", F.lit(True)), "cluster", "left").join(refs.select(F.col("cluster").alias("_short"), F.lit(True).alias("_bare")), "_short", "left")
    moved = F.col("_own").isNull() & F.col("_bare").isNotNull() & F.col("cluster").rlike("^cluster_[0-9]+$")
    named = marked.withColumn("_name", F.when(moved, F.col("_short")).otherwise(F.col("cluster")))
    named = named.select("cluster", "_name", F.count("*").over(Window.partitionBy("_name")).alias("_n"))
    named = refuse(named, F.col("_n") > 1, F.concat(F.lit("two spellings of cluster "), F.col("_name"))).drop("_n")
    return rows.join(named, "cluster").withColumn("cluster", F.col("_name")).drop("_name")


def pathway_weights(pathways: DataFrame, factor_weights: DataFrame, peak_genes: DataFrame) -> DataFrame:
    """pathways(cluster, tf_name, peak_id, affected_gene) with mean weights of their two edges; null where there is no finite one.

    factor_weights(cluster, tf_gene, peak_id, weight); peak_genes(cluster, peak_id, gene, atac_coef, pearson_r).
    """
    mean = lambda c: F.avg(F.when(finite(F.col(c)), F.col(c)))
    known = factor_weights.select("cluster").union(peak_genes.select("cluster"))
    up = factor_weights.groupBy("cluster", F.col("tf_gene").alias("tf_name"), "peak_id").agg(mean("weight").alias("tf_peak_weight"))
    down = peak_genes.groupBy("cluster", "peak_id", F.col("gene").alias("affected_gene")).agg(mean("atac_coef").alias("peak_gene_coef"), mean("pearson_r").alias("peak_gene_pearson_r"))
    return reconcile_clusters(pathways, known).join(up, ["cluster", "tf_name", "peak_id"], "left").join(down, ["cluster", "peak_id", "affected_gene"], "left")


def effects_with_fit(effects: DataFrame, fits: DataFrame, named: int = 15) -> DataFrame:
    """effects(gene, mean_delta) with mean_r2 and n_edges of fits(gene, r2), their class, and labelled: the `named` best of |delta| x r2.

    Up and Down pass 1 in size; only those are labelled, and a gene without a fit has no score.
    """
    r2 = fits.groupBy("gene").agg(F.avg("r2").alias("mean_r2"), F.count("*").alias("n_edges"))
    scored = effects.join(r2, "gene", "left").withColumn("change", F.when(F.col("mean_delta") > 1, "Up").when(F.col("mean_delta") < -1, "Down").otherwise("Stable"))
    scored = scored.withColumn("label_score", F.abs("mean_delta") * F.when(F.col("mean_r2").isNotNull(), F.greatest("mean_r2", F.lit(0.0))))
    top = scored.where("label_score is not null").orderBy(F.desc(F.round("label_score", 9)), "gene").limit(named).select("gene", F.lit(True).alias("_top"))
    return scored.join(top, "gene", "left").withColumn("labelled", F.coalesce(F.col("_top"), F.lit(False)) & (F.col("change") != "Stable")).drop("_top")


def changed_relations(changes: DataFrame, valid: DataFrame) -> DataFrame:
    """Distinct (source, target) of changes(bin, source, target, value) that are finite, not 0 and of a valid(bin, target)."""
    moved = changes.where(finite(F.col("value")) & (F.col("value") != 0)).where("source is not null and target is not null")
    if "status" in changes.columns:
        moved = moved.where("status = 'ok'")
    return moved.join(valid.select("bin", "target"), ["bin", "target"], "left_semi").select("source", "target").distinct()


def aligned_rows(targets: DataFrame, inputs: DataFrame, routes: DataFrame) -> DataFrame:
    """(peak_id, tf, branch, bin, y, x, supported): targets' values beside the inputs' at each bin's own source bin.

    targets and inputs are (feature_id, branch, bin, value). Where a route has no lag x is 0 and supported false. A supported
    route must start at a bin of the branch at or before its own, at the lag it states; anything else is an error.
    """
    lag = F.col("bin") - F.col("source_bin")
    supported = F.col("status") == "supported"
    wrong = F.when(supported, (F.col("source_bin") < 0) | (lag < 0) | (lag != F.col("selected_lag"))).otherwise(F.col("source_bin") != -1)
    checked = refuse(routes, F.coalesce(wrong, F.lit(True)), F.lit("a route and its lag differ")).select("tf", "peak_id", "branch", "bin", supported.alias("supported"), F.when(supported, F.col("source_bin")).alias("_s"))
    x = inputs.select(F.col("feature_id").alias("tf"), "branch", F.col("bin").alias("_s"), F.col("value").alias("_x"))
    y = targets.select(F.col("feature_id").alias("peak_id"), "branch", "bin", F.col("value").alias("y"))
    joined = checked.join(x, ["tf", "branch", "_s"], "left").join(y, ["peak_id", "branch", "bin"])
    gone = F.col("supported") & F.col("_x").isNull()
    joined = refuse(joined, gone, F.lit("a route starts at a bin without a state"))
    return joined.select("peak_id", "tf", "branch", "bin", "y", F.coalesce("_x", F.lit(0.0)).alias("x"), "supported")


def top_responses(curves: DataFrame, limit: int = 5) -> DataFrame:
    """The best curves(tf, peak_id, lag, alpha, r2) by training R2, of those with weight and a finite R2; ties by name, peak and lag."""
    return curves.where((F.col("alpha") > 0) & finite(F.col("r2"))).orderBy(F.desc("r2"), "tf", "peak_id", F.col("lag").cast("string")).limit(limit)


def peak_reports(summary: DataFrame) -> DataFrame:
    """(peak_id, report): a text a peak of summary(peak_id, cluster, baseline, perturbed, delta, n_upstream, n_genes, n_edges)."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    upstream = F.when(count("n_upstream") > 0, F.format_string("B upstream factors: %d", count("n_upstream"))).otherwise("B upstream factors: none found with confidence")
    blocks = [
        F.format_string("Peak %s in cluster %s", F.col("peak_id").cast("string"), F.col("cluster").cast("string")),
        F.format_string("A accessibility: %.4f before, %.4f after, change %.4f", "baseline", "perturbed", "delta"),
        upstream,
        F.format_string("C direct effects: %d genes over %d edges", count("n_genes"), count("n_edges")),
    ]
    return summary.select("peak_id", F.concat_ws("\n", *blocks).alias("report"))
