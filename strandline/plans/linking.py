"""Queries on linked identifiers: labels of cells, names of genes, requests, routes and report joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import linking, screening
from strandline.plans.cohort import ROUTES, bin_state, factor_edges
from strandline.plans.effects import ENDPOINTS, endpoints
from strandline.plans.frames import CELLS, cells, read, rna
from strandline.plans.registry import query
from strandline.storage import written


@query(f"""WITH {CELLS}, r AS (SELECT DISTINCT l_orderkey AS cell_id FROM lineitem) SELECT branch, o_orderpriority AS label, count(*) AS n FROM cells JOIN r USING (cell_id) JOIN orders ON o_orderkey = cell_id GROUP BY 1, 2""")
def reference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells cut to those with expression, and labels attached to exactly these."""
    reference = rna(spark, sf_dir).select("cell_id").distinct()
    labels = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("label")).join(reference, "cell_id", "left_semi")
    model = linking.align_cells(cells(spark, sf_dir), reference)
    return linking.attach_labels(model, labels).groupBy("branch", "label").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT DISTINCT 'nation' AS kind, CAST(c_nationkey AS VARCHAR) AS label FROM customer UNION SELECT 'segment', c_mktsegment FROM customer UNION SELECT 'name', c_name FROM customer), w AS (SELECT kind, bool_and(TRY_CAST(label AS BIGINT) IS NOT NULL) AS whole FROM l GROUP BY 1)
SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN whole THEN TRY_CAST(label AS BIGINT) END, label) AS place FROM l JOIN w USING (kind)""")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of labels: nations as numbers, segments and names as text."""
    c = read(spark, sf_dir, "customer")
    of = lambda kind, column: c.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("label"))
    return linking.ordered_labels(of("nation", "c_nationkey").union(of("segment", "c_mktsegment")).union(of("name", "c_name")), "kind", "label")


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part), g AS (SELECT id, name, CASE WHEN n = 1 THEN name ELSE name || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') END AS label FROM n),
r AS (SELECT DISTINCT l_orderkey, l_linestatus, l_partkey FROM lineitem), v AS (SELECT l_orderkey, l_linestatus, count(*) = 1 AND l_linestatus = 'O' AS hidden, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS ids, string_agg(name, ',' ORDER BY l_partkey) AS names, string_agg(label, ',' ORDER BY l_partkey) AS labels FROM r JOIN g ON id = l_partkey GROUP BY 1, 2)
SELECT l_orderkey, l_linestatus, CASE WHEN hidden THEN 'unknown' ELSE ids END AS gene_id, CASE WHEN hidden THEN 'unknown' ELSE names END AS gene_name, CASE WHEN hidden THEN 'unknown' ELSE labels END AS gene, CASE WHEN NOT hidden THEN '["' || replace(names, ',', '","') || '"]' END AS gene_names_json FROM v""")
def gene_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts as genes with names and numbered labels; lone open ones stand for unknown."""
    parts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sort_array(F.collect_set("l_partkey")).alias("_p"))
    hidden = (F.size("_p") == 1) & (F.col("l_linestatus") == "O")
    rows = parts.select("l_orderkey", "l_linestatus", F.when(hidden, "unknown").otherwise(F.array_join(F.col("_p").cast("array<string>"), ",")).alias("gene"))
    records = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return linking.present_genes(rows, records, "gene").select("l_orderkey", "l_linestatus", "gene_id", "gene_name", "gene", "gene_names_json")


SCOPE = "CASE affected_gene % 7 WHEN 0 THEN 'unavailable' WHEN 1 THEN NULL ELSE 'full' END"


@query(f"""WITH {ENDPOINTS}, e AS (SELECT *, log2(perturbed_mean / control_mean) AS d, {SCOPE} AS scope FROM endpoints) SELECT source_context, target_gene, affected_gene, round(d, 6) + 0.0 AS plot_delta, coalesce(isfinite(d), false) AND status = 'ok' AND coalesce(scope <> 'unavailable', true) AS plot_available FROM e""")
def available_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = endpoints(spark, sf_dir)[0].withColumn("delta_rna_log2fc", F.log2(F.col("perturbed_mean") / F.col("control_mean"))).withColumn("aggregation_scope", F.expr(SCOPE))
    shown = linking.available_effects(ep)
    return shown.select("source_context", "target_gene", "affected_gene", (F.round("plot_delta", 6) + 0.0).alias("plot_delta"), "plot_available")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS target, l_partkey AS input FROM lineitem WHERE l_discount > 0.05), d AS (SELECT DISTINCT l_suppkey AS target, l_partkey AS input FROM lineitem WHERE l_tax > 0.02) SELECT * FROM a EXCEPT SELECT * FROM d""")
def undeclared_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: read(spark, sf_dir, "lineitem").where(c).select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("input"))
    return linking.undeclared_changes(pick("l_discount > 0.05"), pick("l_tax > 0.02"))


@query("""WITH a AS (SELECT p_name || '/' || p_brand || '/' || p_size AS alias, CAST(p_partkey AS VARCHAR) AS id FROM part), q AS (SELECT alias AS request FROM a UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem UNION SELECT c_name FROM customer), g AS (SELECT alias, min(id) AS lo, count(DISTINCT id) AS n FROM a GROUP BY 1)
SELECT request, CASE WHEN i.id IS NOT NULL OR n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN i.id IS NOT NULL THEN request WHEN n = 1 THEN lo END AS id FROM q LEFT JOIN (SELECT DISTINCT id FROM a) i ON i.id = request LEFT JOIN g ON g.alias = request""")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by id, by names of one or several parts, and by names of nothing."""
    p = read(spark, sf_dir, "part")
    aliases = p.select(F.concat_ws("/", "p_name", "p_brand", F.col("p_size").cast("string")).alias("alias"), F.col("p_partkey").cast("string").alias("id"))
    requests = aliases.select(F.col("alias").alias("request")).union(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string"))).union(read(spark, sf_dir, "customer").select("c_name"))
    return linking.request_matches(requests, aliases)


@query("""WITH p AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS cluster, l_suppkey % 30 AS tf_name, l_partkey % 40 AS peak_id, l_orderkey % 50 AS affected_gene FROM lineitem),
t AS (SELECT CAST(l_linenumber AS VARCHAR) AS cluster, l_suppkey % 30 AS tf_name, l_partkey % 40 AS peak_id, avg(l_discount) AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3), g AS (SELECT CAST(l_linenumber AS VARCHAR) AS cluster, l_partkey % 40 AS peak_id, l_orderkey % 50 AS affected_gene, avg(l_tax) AS c, avg(l_discount) AS r FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3)
SELECT cluster, tf_name, peak_id, affected_gene, round(w, 6) AS tf_peak_weight, round(c, 6) AS peak_gene_coef, round(r, 6) AS peak_gene_pearson_r FROM p LEFT JOIN t USING (cluster, tf_name, peak_id) LEFT JOIN g USING (cluster, peak_id, affected_gene)""")
def pathway_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pathways, whose clusters are spelt with a prefix, beside the mean weights of their edges."""
    line = read(spark, sf_dir, "lineitem").withColumn("cluster", F.col("l_linenumber").cast("string"))
    tf, peak, gene = F.col("l_suppkey") % 30, (F.col("l_partkey") % 40).alias("peak_id"), F.col("l_orderkey") % 50
    paths = line.select(F.concat(F.lit("cluster_"), "cluster").alias("cluster"), tf.alias("tf_name"), peak, gene.alias("affected_gene")).distinct()
    up = line.where("l_returnflag = 'A'").select("cluster", tf.alias("tf_gene"), peak, F.col("l_discount").alias("weight"))
    down = line.where("l_returnflag <> 'A'").select("cluster", peak, gene.alias("gene"), F.col("l_tax").alias("atac_coef"), F.col("l_discount").alias("pearson_r"))
    w = linking.pathway_weights(paths, up, down)
    return w.select("cluster", "tf_name", "peak_id", "affected_gene", *(F.round(c, 6).alias(c) for c in ("tf_peak_weight", "peak_gene_coef", "peak_gene_pearson_r")))


@query("""WITH e AS (SELECT l_partkey AS gene, (avg(l_quantity) - 25.5) / 5 AS d FROM lineitem GROUP BY 1), f AS (SELECT l_partkey AS gene, avg(l_discount * 10) AS r2, count(*) AS n_edges FROM lineitem WHERE l_tax > 0.06 GROUP BY 1),
s AS (SELECT gene, d, r2, n_edges, CASE WHEN d > 1 THEN 'Up' WHEN d < -1 THEN 'Down' ELSE 'Stable' END AS change, abs(d) * greatest(r2, 0) AS score FROM e LEFT JOIN f USING (gene)), t AS (SELECT gene FROM s WHERE score IS NOT NULL ORDER BY round(score, 9) DESC, gene LIMIT 15)
SELECT gene, round(d, 6) + 0.0 AS mean_delta, round(r2, 6) AS mean_r2, n_edges, change, gene IN (SELECT gene FROM t) AND change <> 'Stable' AS labelled FROM s""")
def effects_with_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").withColumn("gene", F.col("l_partkey"))
    effects = line.groupBy("gene").agg(((F.avg("l_quantity") - 25.5) / 5).alias("mean_delta"))
    e = linking.effects_with_fit(effects, line.where("l_tax > 0.06").select("gene", F.expr("l_discount * 10").alias("r2")))
    return e.select("gene", (F.round("mean_delta", 6) + 0.0).alias("mean_delta"), F.round("mean_r2", 6).alias("mean_r2"), "n_edges", "change", "labelled")


@query("""WITH v AS (SELECT DISTINCT l_linenumber AS bin, l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R') SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem JOIN v ON bin = l_linenumber AND v.target = l_suppkey WHERE l_discount <> 0 AND l_linestatus = 'O'""")
def changed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that changed where their target was valid in the same bin."""
    line = read(spark, sf_dir, "lineitem")
    changes = line.select(F.col("l_linenumber").alias("bin"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_discount").alias("value"), F.when(F.col("l_linestatus") == "O", "ok").alias("status"))
    return linking.changed_relations(changes, line.where("l_returnflag = 'R'").select(F.col("l_linenumber").alias("bin"), F.col("l_suppkey").alias("target")))


@query(f"""WITH {ROUTES}, o AS (SELECT l.tf, l.peak_id, l.branch, l.bin, lag, y.value AS y, x.value AS x FROM l JOIN a y ON y.feature_id = l.peak_id AND y.branch = l.branch AND y.bin = l.bin LEFT JOIN r x ON x.feature_id = l.tf AND x.branch = l.branch AND x.bin = l.bin - l.lag)
SELECT peak_id, tf, branch, bin, round(y, 6) AS y, round(coalesce(x, 0), 6) AS x, lag IS NOT NULL AS supported FROM o""")
def aligned_lag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for single fits: a peak's value beside its factor's at the source bin that each bin selected."""
    genes, peaks = (written(t, "state") for t in bin_state(spark, sf_dir, 16))
    routes = screening.local_lag_routes(screening.local_lag_tests(genes, peaks, factor_edges(spark, sf_dir), 3), 0.05)
    return linking.aligned_rows(peaks, genes, routes).select("peak_id", "tf", "branch", "bin", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "supported")


@query("""WITH c AS (SELECT l_suppkey AS tf, l_partkey % 40 AS peak_id, l_linenumber AS lag, avg(l_discount) - 0.02 AS alpha, round(avg(l_tax), 9) AS r2 FROM lineitem GROUP BY 1, 2, 3) SELECT tf, peak_id, lag, r2 FROM c WHERE alpha > 0 ORDER BY r2 DESC, tf, peak_id, CAST(lag AS VARCHAR) LIMIT 25""")
def top_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tf"), (F.col("l_partkey") % 40).alias("peak_id"), F.col("l_linenumber").alias("lag")).agg((F.avg("l_discount") - 0.02).alias("alpha"), F.round(F.avg("l_tax"), 9).alias("r2"))
    return linking.top_responses(curves, 25).select("tf", "peak_id", "lag", "r2")


@query("""WITH s AS (SELECT l_suppkey AS peak_id, l_linenumber AS cluster, round(avg(ln(1 + l_extendedprice)), 4) AS b, round(avg(ln(1 + l_extendedprice * (1 - l_discount))), 4) AS p, count(DISTINCT l_partkey % 9) FILTER (l_returnflag = 'R') AS u, count(DISTINCT l_partkey) AS g, count(*) AS e FROM lineitem GROUP BY 1, 2)
SELECT peak_id, printf('Peak %s in cluster %s', CAST(peak_id AS VARCHAR), CAST(cluster AS VARCHAR)) || chr(10) || printf('A accessibility: %.4f before, %.4f after, change %.4f', b, p, round(p - b, 4)) || chr(10) || CASE WHEN u > 0 THEN printf('B upstream factors: %d', u) ELSE 'B upstream factors: none found with confidence' END || chr(10) || printf('C direct effects: %d genes over %d edges', g, e) AS report FROM s""")
def peak_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.when(F.col("l_returnflag") == "R", F.col("l_partkey") % 9)
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("peak_id"), F.col("l_linenumber").alias("cluster")).agg(F.round(F.avg(F.log1p("l_extendedprice")), 4).alias("baseline"), F.round(F.avg(F.expr("ln(1 + l_extendedprice * (1 - l_discount))")), 4).alias("perturbed"), F.countDistinct(back).alias("n_upstream"), F.countDistinct("l_partkey").alias("n_genes"), F.count("*").alias("n_edges"))
    return linking.peak_reports(s.withColumn("delta", F.round(F.col("perturbed") - F.col("baseline"), 4)))
