"""Effect, pathway and report queries; customers' nations are contexts, market segments and parts stand for targets and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import effects as fx
from strandline.plans.frames import ATAC, CELLS, RNA, atac, bins_sql, cells, means_sql, read, rna
from strandline.plans.registry import query
from strandline.storage import written

ENDPOINTS = """ep AS (SELECT c_nationkey % 5 AS source_context, o_orderpriority AS target_gene, l_partkey % 30 AS affected_gene, avg(l_extendedprice) AS control_mean, avg(l_extendedprice * (1 - l_discount)) AS perturbed_mean, count(*) AS n, min(l_partkey) AS low FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
endpoints AS (SELECT source_context, target_gene, affected_gene, control_mean, perturbed_mean, CASE WHEN (affected_gene + source_context) % 11 = 0 THEN 'quality_filtered' WHEN (affected_gene + source_context) % 13 = 0 THEN 'unavailable' ELSE 'ok' END AS status FROM ep WHERE (affected_gene * 3 + source_context) % 17 <> 0),
contexts AS (SELECT c_nationkey % 5 AS source_context, count(*) AS n_cells FROM customer GROUP BY 1)"""


def endpoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    j = line.join(o, line.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey)
    ep = j.groupBy((F.col("c_nationkey") % 5).alias("source_context"), F.col("o_orderpriority").alias("target_gene"), (F.col("l_partkey") % 30).alias("affected_gene")).agg(F.avg("l_extendedprice").alias("control_mean"), F.avg(F.expr("l_extendedprice * (1 - l_discount)")).alias("perturbed_mean"))
    k = F.col("affected_gene") + F.col("source_context")
    status = F.when(k % 11 == 0, "quality_filtered").when(k % 13 == 0, "unavailable").otherwise("ok")
    ep = ep.where((F.col("affected_gene") * 3 + F.col("source_context")) % 17 != 0).withColumn("status", status)
    return ep, c.groupBy((F.col("c_nationkey") % 5).alias("source_context")).agg(F.count("*").alias("n_cells"))


@query(f"""WITH {ENDPOINTS}, p AS (SELECT DISTINCT target_gene, affected_gene FROM endpoints), f AS (SELECT p.*, c.source_context, n_cells, control_mean, perturbed_mean, coalesce(status = 'ok', false) AS used FROM p CROSS JOIN contexts c LEFT JOIN endpoints e ON e.source_context = c.source_context AND e.target_gene = p.target_gene AND e.affected_gene = p.affected_gene),
s AS (SELECT target_gene, affected_gene, sum(n_cells * control_mean) FILTER (used) AS c, sum(n_cells * perturbed_mean) FILTER (used) AS p, coalesce(sum(n_cells) FILTER (used), 0) AS u, sum(n_cells) AS a, count(*) FILTER (NOT used) AS n_excluded FROM f GROUP BY 1, 2)
SELECT target_gene, affected_gene, round(log2(p / c), 6) + 0.0 AS log2_fold, CAST(u AS BIGINT) AS used_cells, round(u / a, 6) AS cell_fraction, CASE WHEN u = 0 THEN 'unavailable' WHEN u = a THEN 'full' ELSE 'partial' END AS effect_scope, n_excluded FROM s WHERE log2(p / c) IS NULL OR abs(log2(p / c)) >= 1e-6""")
def pooled_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled effects over valid contexts with scopes and exclusions."""
    p = fx.pooled_fold_change(*endpoints(spark, sf_dir))
    n = F.size(F.map_keys(F.from_json("excluded", "map<string,string>"))).cast("long")
    return p.select("target_gene", "affected_gene", (F.round("log2_fold", 6) + 0.0).alias("log2_fold"), "used_cells", F.round("cell_fraction", 6).alias("cell_fraction"), "effect_scope", n.alias("n_excluded"))


@query(f"""WITH {ENDPOINTS}, b AS (SELECT source_context, affected_gene, max(control_mean) AS base FROM endpoints GROUP BY 1, 2), p AS (SELECT DISTINCT target_gene, affected_gene FROM endpoints),
f AS (SELECT p.*, n_cells, base, CASE WHEN e.status = 'ok' THEN e.perturbed_mean ELSE base END AS after FROM p CROSS JOIN contexts c JOIN b ON b.source_context = c.source_context AND b.affected_gene = p.affected_gene LEFT JOIN endpoints e ON e.source_context = c.source_context AND e.target_gene = p.target_gene AND e.affected_gene = p.affected_gene)
SELECT target_gene, affected_gene, round(greatest(-10, least(10, log2(sum(n_cells * after) / sum(n_cells * base)))), 6) + 0.0 AS log2_fold FROM f GROUP BY 1, 2""")
def complete_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.complete_fold_change(*endpoints(spark, sf_dir)).select("target_gene", "affected_gene", (F.round("log2_fold", 6) + 0.0).alias("log2_fold"))


@query(f"""WITH {ENDPOINTS}, d AS (SELECT target_gene, affected_gene, n_cells, log2(perturbed_mean / control_mean) AS delta FROM endpoints JOIN contexts USING (source_context) WHERE status = 'ok')
SELECT target_gene, affected_gene, round(sum(n_cells * delta) / (SELECT sum(n_cells) FROM contexts), 6) + 0.0 AS mean_delta, round(sum(n_cells * abs(delta)) / (SELECT sum(n_cells) FROM contexts), 6) AS mean_abs_delta, count(*) AS n_contexts FROM d GROUP BY 1, 2""")
def weighted_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep, ctx = endpoints(spark, sf_dir)
    total = float(ctx.agg(F.sum("n_cells")).first()[0])
    d = ep.where("status = 'ok'").join(F.broadcast(ctx), "source_context").withColumn("delta", F.log2(F.col("perturbed_mean") / F.col("control_mean")))
    w = fx.weighted_deltas(d, ["target_gene", "affected_gene"], "n_cells", total)
    return w.select("target_gene", "affected_gene", (F.round("mean_delta", 6) + 0.0).alias("mean_delta"), F.round("mean_abs_delta", 6).alias("mean_abs_delta"), "n_contexts")


CHANGES = """ch AS (SELECT o_orderpriority AS target_gene, l_suppkey % 40 AS peak_id, c_nationkey % 5 AS ctx, avg(l_tax - l_discount) AS delta, avg(l_quantity - 25.5) AS z_score, count(*) AS n_cells, CASE WHEN (l_suppkey % 40 + c_nationkey % 5) % 23 = 0 THEN 'unavailable' ELSE 'ok' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 7)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    j = line.join(o, line.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey)
    ch = j.groupBy(F.col("o_orderpriority").alias("target_gene"), (F.col("l_suppkey") % 40).alias("peak_id"), (F.col("c_nationkey") % 5).alias("ctx")).agg(F.avg(F.expr("l_tax - l_discount")).alias("delta"), F.avg(F.expr("l_quantity - 25.5")).alias("z_score"), F.count("*").alias("n_cells"))
    return ch.withColumn("status", F.when((F.col("peak_id") + F.col("ctx")) % 23 == 0, "unavailable").otherwise("ok"))


@query(f"""WITH {CHANGES} SELECT target_gene, peak_id, CASE WHEN NOT bool_or(status = 'unavailable') THEN round(sum(n_cells * delta) / sum(n_cells), 6) + 0.0 END AS delta, CASE WHEN NOT bool_or(status = 'unavailable') THEN round(sum(n_cells * abs(delta)) / sum(n_cells), 6) END AS abs_delta, CASE WHEN bool_or(status = 'unavailable') THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN NOT bool_or(status = 'unavailable') THEN abs(sum(n_cells * z_score) / sum(n_cells)) >= 2 END AS significant FROM ch GROUP BY 1, 2""")
def merged_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.merge_accessibility(changes(spark, sf_dir))
    return m.select("target_gene", "peak_id", (F.round("delta", 6) + 0.0).alias("delta"), F.round("abs_delta", 6).alias("abs_delta"), "status", "significant")


@query(f"""WITH {CHANGES} SELECT peak_id, target_gene, round(delta, 6) + 0.0 AS delta FROM (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY abs(delta) DESC, target_gene) AS k FROM ch) WHERE k = 1""")
def strongest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest change of each peak over all interventions and contexts."""
    best = fx.strongest_change(changes(spark, sf_dir).where("delta is not null"))
    return best.select("peak_id", "target_gene", (F.round("delta", 6) + 0.0).alias("delta"))


@query(f"""WITH {CELLS}, {ATAC}, {bins_sql(16)}, {means_sql("atac", "a")}, {CHANGES}, d AS (SELECT peak_id, avg(delta) AS delta FROM ch GROUP BY 1), s AS (SELECT feature_id AS peak_id, stddev_pop(value) AS sd FROM a GROUP BY 1)
SELECT peak_id, round(delta, 6) + 0.0 AS delta, round(CASE WHEN sd > 1e-10 THEN delta / sd ELSE 0 END, 6) + 0.0 AS z_score FROM d JOIN s USING (peak_id)""")
def accessibility_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.plans.cohort import bin_state

    _, peaks = bin_state(spark, sf_dir, 16)
    z = fx.z_scores(changes(spark, sf_dir), peaks.withColumnRenamed("feature_id", "peak_id"))
    return z.select("peak_id", (F.round("delta", 6) + 0.0).alias("delta"), (F.round("z_score", 6) + 0.0).alias("z_score"))


PATHS = """f AS (SELECT o_orderpriority AS target_gene, o_custkey % 3 AS source_context, 0 AS branch, CAST(l_linenumber + 3 AS INTEGER) AS bin, CAST(l_linenumber + 3 - l_partkey % 3 AS INTEGER) AS source_bin, l_partkey % 12 AS tf, l_suppkey % 20 AS peak_id, round(sum(l_discount - 0.05), 9) AS delta, CASE WHEN l_partkey % 5 = 0 THEN 'group' ELSE 'single' END AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5, 6, 7, 9),
p AS (SELECT o_orderpriority AS target_gene, o_custkey % 3 AS source_context, 0 AS branch, CAST(l_linenumber + 3 AS INTEGER) AS bin, l_partkey % 9 AS gene, l_suppkey % 20 AS peak_id, round(sum(l_tax - 0.04), 9) AS delta, 'single' AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5, 6),
e AS (SELECT o_orderpriority AS target_gene, o_custkey % 3 AS source_context, l_partkey % 9 AS gene, sum(CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_tax END) AS effect FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


def path_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    # three tables come from one join
    j = written(line.join(o, line.l_orderkey == o.o_orderkey).select("o_orderpriority", "o_custkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"), "lines")
    base = [F.col("o_orderpriority").alias("target_gene"), (F.col("o_custkey") % 3).alias("source_context")]
    bin_ = (F.col("l_linenumber") + 3).cast("int")
    place = [F.lit(0).alias("branch"), bin_.alias("bin")]
    peak = (F.col("l_suppkey") % 20).alias("peak_id")
    f = j.groupBy(*base, *place, (bin_ - F.col("l_partkey") % 3).cast("int").alias("source_bin"), (F.col("l_partkey") % 12).alias("tf"), peak, F.when(F.col("l_partkey") % 5 == 0, "group").otherwise("single").alias("method")).agg(F.round(F.sum(F.expr("l_discount - 0.05D")), 9).alias("delta"))
    p = j.groupBy(*base, *place, (F.col("l_partkey") % 9).alias("gene"), peak).agg(F.round(F.sum(F.expr("l_tax - 0.04D")), 9).alias("delta")).withColumn("method", F.lit("single"))
    e = j.groupBy(*base, (F.col("l_partkey") % 9).alias("gene")).agg(F.sum(F.when(F.col("l_partkey") % 4 == 0, 0.0).otherwise(F.col("l_tax"))).alias("effect"))
    return f, p, e


@query(f"""WITH {PATHS} SELECT f.source_context, f.target_gene, tf, f.peak_id, p.gene, f.bin - source_bin AS lag, count(*) AS event_count, min(f.bin) AS first_bin, max(f.bin) AS last_bin, round(sum(f.delta), 4) + 0.0 AS tf_sum, round(sum(p.delta), 4) + 0.0 AS peak_sum, round(max(effect), 4) AS effect, array_to_string(list_sort(list_distinct(list(f.method))), ',') AS tf_methods, 'none' AS clips
FROM f JOIN p ON p.source_context = f.source_context AND p.target_gene = f.target_gene AND p.branch = f.branch AND p.peak_id = f.peak_id AND p.bin = f.bin + 1 JOIN e ON e.source_context = f.source_context AND e.target_gene = f.target_gene AND e.gene = p.gene WHERE f.delta <> 0 AND p.delta <> 0 AND effect <> 0 GROUP BY 1, 2, 3, 4, 5, 6""")
def temporal_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes factor -> peak -> gene one bin apart, rolled up."""
    r = fx.pathways(*path_tables(spark, sf_dir))
    return r.select("source_context", "target_gene", "tf", "peak_id", "gene", "lag", "event_count", "first_bin", "last_bin", *((F.round(c, 4) + 0.0).alias(c) for c in ("tf_sum", "peak_sum")), F.round("effect", 4).alias("effect"), "tf_methods", "clips")


GENE_EFFECTS = "ge AS (SELECT c_nationkey % 7 AS cluster, l_partkey % 50 AS gene, avg(l_discount - 0.05) AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"


def gene_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    j = line.join(o, line.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey)
    return j.groupBy((F.col("c_nationkey") % 7).alias("cluster"), (F.col("l_partkey") % 50).alias("gene")).agg(F.avg(F.expr("l_discount - 0.05D")).alias("delta"))


@query(f"""WITH {GENE_EFFECTS}, g AS (SELECT gene, count(DISTINCT cluster) AS n, max(delta) - min(delta) AS rg, coalesce(stddev_samp(delta), 0) AS sd, count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down FROM ge GROUP BY 1)
SELECT gene, n, up > 0 AND down > 0 AS sign_switch, round(n / (SELECT count(DISTINCT cluster) FROM ge) * (rg + sd) * CASE WHEN up > 0 AND down > 0 THEN 1.25 ELSE 1.0 END * (1 + CASE WHEN up + down > 0 THEN least(up, down) / greatest(up, down) ELSE 0 END), 6) AS score FROM g""")
def heterogeneity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.heterogeneity(gene_effects(spark, sf_dir)).select("gene", "n", "sign_switch", F.round("score", 6).alias("score"))


@query(f"""WITH {GENE_EFFECTS} SELECT cluster, gene, round(delta, 6) + 0.0 AS delta, rk FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(delta) DESC, gene) AS rk FROM ge) WHERE rk <= 5""")
def top_affected_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy(F.desc(F.abs("delta")), "gene")
    return gene_effects(spark, sf_dir).withColumn("rk", F.row_number().over(order).cast("long")).where("rk <= 5").select("cluster", "gene", (F.round("delta", 6) + 0.0).alias("delta"), "rk")


@query(f"""WITH {GENE_EFFECTS} SELECT gene, {", ".join(f"round(avg(delta) FILTER (cluster = {k}), 6) + 0.0 AS c{k}" for k in range(7))} FROM ge WHERE gene % 3 <> 0 OR cluster <> 2 GROUP BY 1""")
def effect_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene x cluster means; missing stays null."""
    wide = gene_effects(spark, sf_dir).where("gene % 3 <> 0 or cluster <> 2").groupBy("gene").pivot("cluster", list(range(7))).avg("delta")
    return wide.select("gene", *((F.round(str(k), 6) + 0.0).alias(f"c{k}") for k in range(7)))


@query(f"""WITH {GENE_EFFECTS}, w AS (SELECT gene, avg(delta) FILTER (cluster = 0) AS c0, avg(delta) FILTER (cluster = 1) AS c1 FROM ge GROUP BY 1) SELECT gene, k AS cluster, round(v, 6) + 0.0 AS delta FROM (SELECT gene, 'c0' AS k, c0 AS v FROM w UNION ALL SELECT gene, 'c1', c1 FROM w)""")
def effect_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = gene_effects(spark, sf_dir).where("cluster < 2").groupBy("gene").pivot("cluster", [0, 1]).avg("delta").toDF("gene", "c0", "c1")
    return wide.unpivot("gene", ["c0", "c1"], "cluster", "delta").select("gene", "cluster", (F.round("delta", 6) + 0.0).alias("delta"))


@query(f"""WITH {GENE_EFFECTS} SELECT CASE WHEN delta > 0.001 THEN 'up' WHEN delta < -0.001 THEN 'down' ELSE 'flat' END AS class, count(*) AS n, count(DISTINCT gene) AS n_genes FROM ge GROUP BY 1""")
def effect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("delta") > 0.001, "up").when(F.col("delta") < -0.001, "down").otherwise("flat")
    return gene_effects(spark, sf_dir).groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.countDistinct("gene").alias("n_genes"))


UPDOWN = "up AS (SELECT o_custkey % 4 AS cluster, l_partkey % 15 AS tf, l_suppkey % 25 AS peak_id, sum(l_discount - 0.05) AS up FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), down AS (SELECT o_custkey % 4 AS cluster, l_suppkey % 25 AS peak_id, l_partkey % 18 AS gene, sum(l_tax) AS down FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


@query(f"""WITH {UPDOWN}, j AS (SELECT u.cluster, tf, gene, sum(sqrt(abs(up) * abs(down))) AS j FROM up u JOIN down d ON u.cluster = d.cluster AND u.peak_id = d.peak_id GROUP BY 1, 2, 3),
t AS (SELECT * FROM (SELECT cluster, tf, row_number() OVER (PARTITION BY cluster ORDER BY round(sum(j), 6) DESC, tf) AS tf_rank FROM j GROUP BY 1, 2) WHERE tf_rank <= 3)
SELECT * FROM (SELECT cluster, tf, gene, CAST(tf_rank AS INTEGER) AS tf_rank, CAST(row_number() OVER (PARTITION BY cluster, tf ORDER BY round(j, 6) DESC, gene) AS INTEGER) AS gene_rank, round(j, 5) AS joint FROM j JOIN t USING (cluster, tf)) WHERE gene_rank <= 4""")
def contribution_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top factors of each cluster and their top genes by joint contribution."""
    line, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    j = line.join(o, line.l_orderkey == o.o_orderkey)
    c, peak = (F.col("o_custkey") % 4).alias("cluster"), (F.col("l_suppkey") % 25).alias("peak_id")
    up = j.groupBy(c, (F.col("l_partkey") % 15).alias("tf"), peak).agg(F.sum(F.expr("l_discount - 0.05D")).alias("up"))
    down = j.groupBy(c, peak, (F.col("l_partkey") % 18).alias("gene")).agg(F.sum("l_tax").alias("down"))
    return fx.joint_contributions(up, down, 3, 4).withColumn("joint", F.round("joint", 5))


@query(f"""WITH {CELLS}, {RNA}, {bins_sql(16)}, {means_sql("rna", "r")}, h AS (SELECT branch, feature_id, bin, value, bin - row_number() OVER (PARTITION BY branch, feature_id ORDER BY bin) AS g FROM r WHERE value > 0.75)
SELECT branch, feature_id, min(bin) AS first_bin, max(bin) AS last_bin, round(max(value), 6) AS peak FROM h GROUP BY branch, feature_id, g""")
def expression_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bins with high expression."""
    from strandline.plans.cohort import bin_state

    genes, _ = bin_state(spark, sf_dir, 16)
    return fx.onsets(genes, ["branch", "feature_id"], 0.75).select("branch", "feature_id", "first_bin", "last_bin", F.round("peak", 6).alias("peak"))


@query(f"""WITH {CELLS}, {RNA}, {bins_sql(16)}, {means_sql("rna", "r")}, s AS (SELECT branch, bin, sum(abs(value)) AS total, count(*) FILTER (abs(value) > 1e-10) AS n_active FROM r GROUP BY 1, 2)
SELECT branch, bin, round(total, 5) AS total, n_active, round(CASE WHEN max(total) OVER (PARTITION BY branch) > 0 THEN total / max(total) OVER (PARTITION BY branch) ELSE 0 END, 6) AS share_of_max, round(sum(total) OVER (PARTITION BY branch ORDER BY bin), 5) AS running FROM s""")
def bin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts of each bin, normalised by the branch's largest, and running totals."""
    from strandline.plans.cohort import bin_state

    genes, _ = bin_state(spark, sf_dir, 16)
    s = genes.groupBy("branch", "bin").agg(F.sum(F.abs("value")).alias("total"), F.sum((F.abs("value") > 1e-10).cast("long")).alias("n_active"))
    own = Window.partitionBy("branch")
    top = F.max("total").over(own)
    return s.select("branch", "bin", F.round("total", 5).alias("total"), "n_active", F.round(F.when(top > 0, F.col("total") / top).otherwise(0.0), 6).alias("share_of_max"), F.round(F.sum("total").over(own.orderBy("bin")), 5).alias("running"))


@query(f"""WITH {RNA}, t AS (SELECT cell_id, sum(value) AS t FROM rna GROUP BY 1), l AS (SELECT r.cell_id, feature_id, ln(1 + 10000 * value / t) AS v FROM rna r JOIN t USING (cell_id)) SELECT feature_id, round(avg(exp(v) - 1), 4) AS before, round(avg(exp(CASE WHEN feature_id IN (0, 1, 2) THEN ln(1 + (exp(v) - 1) * 0.5) ELSE v END) - 1), 4) AS after FROM l GROUP BY 1""")
def partial_knock_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three genes at half strength: CP10k is halved exactly, all else unchanged."""
    from strandline.operators.qc import log_cp10k

    logged = log_cp10k(rna(spark, sf_dir))
    after = fx.knock_out(logged, spark.range(3).select(F.col("id").alias("feature_id")), 0.5)
    both = logged.select("cell_id", "feature_id", F.col("value").alias("v0")).join(after, ["cell_id", "feature_id"])
    return both.groupBy("feature_id").agg(F.round(F.avg(F.expm1("v0")), 4).alias("before"), F.round(F.avg(F.expm1("value")), 4).alias("after"))


@query(f"""WITH {CELLS}, {RNA}, {bins_sql(8)}, t AS (SELECT cell_id, sum(value) AS t FROM rna GROUP BY 1), l AS (SELECT r.cell_id, feature_id, ln(1 + 10000 * value / t) AS v FROM rna r JOIN t USING (cell_id)),
d AS (SELECT l.*, CASE WHEN feature_id % 4 = 0 THEN 0.05 * (b.bin - 3) ELSE 0 END AS d FROM l JOIN binned b USING (cell_id)), a AS (SELECT feature_id, exp(v) - 1 AS before, exp(greatest(exp(ln(1 + v) + d) - 1, 0)) - 1 AS after FROM d)
SELECT feature_id, round(avg(before), 3) AS before, round(avg(after), 3) AS after, round(log2(avg(after) / avg(before)), 6) + 0.0 AS log2_fold FROM a GROUP BY 1""")
def cell_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin-level changes carried to cells and decoded, and the endpoint of each gene."""
    from strandline.operators.binning import equal_frequency_bins
    from strandline.operators.qc import log_cp10k

    binned = equal_frequency_bins(cells(spark, sf_dir), 8)
    bins = binned.select("branch", "bin").distinct().crossJoin(spark.range(0, 40, 4).select(F.col("id").alias("feature_id"))).withColumn("delta", 0.05 * (F.col("bin") - 3))
    r = fx.reconstruct_cells(log_cp10k(rna(spark, sf_dir)), binned.select("cell_id", "branch", "bin", F.lit(1.0).alias("w")), bins)
    m = r.groupBy("feature_id").agg(F.avg("before").alias("b"), F.avg("after").alias("a"))
    return m.select("feature_id", F.round("b", 3).alias("before"), F.round("a", 3).alias("after"), (F.round(F.log2(F.col("a") / F.col("b")), 6) + 0.0).alias("log2_fold"))


@query(f"""WITH {CHANGES} SELECT 'chr' || peak_id % 20 AS chrom, peak_id * 500 AS start, peak_id * 500 + 200 AS stop, target_gene || ':' || ctx AS name, CAST(least(greatest(round(abs(delta) * 1000), 0), 1000) AS INTEGER) AS score FROM ch""")
def bed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = changes(spark, sf_dir)
    named = ch.select(F.concat(F.lit("chr"), F.col("peak_id") % 20).alias("chrom"), (F.col("peak_id") * 500).alias("start"), (F.col("peak_id") * 500 + 200).alias("end"), F.concat("target_gene", F.lit(":"), "ctx").alias("name"), "delta")
    return fx.bed_rows(named).withColumnRenamed("end", "stop")


@query(f"""WITH {ENDPOINTS} SELECT source_context, status, count(*) AS n FROM endpoints GROUP BY 1, 2""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(spark, sf_dir)[0].groupBy("source_context", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {ENDPOINTS}, r AS (SELECT *, CASE WHEN status = 'unavailable' THEN 'unavailable' WHEN affected_gene % 6 = 0 THEN 'quality_filtered' WHEN control_mean <= 0 THEN 'zero_control' WHEN perturbed_mean <= 0 THEN 'zero_perturbed_floor' ELSE 'ok' END AS s, log2(perturbed_mean / control_mean) AS d FROM endpoints) SELECT s AS status, count(*) AS n, count(*) FILTER (s = 'ok' AND affected_gene % 5 <> 0 AND abs(d) > 0.07) AS n_visible FROM r GROUP BY 1""")
def endpoint_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of endpoints and the public effect filter."""
    ep = endpoints(spark, sf_dir)[0]
    s = fx.endpoint_status(F.col("control_mean"), F.col("perturbed_mean"), F.col("status") != "unavailable", F.when(F.col("affected_gene") % 6 == 0, 0.0).otherwise(1.0), 0.5)
    full = ep.withColumn("status", s).withColumn("delta", F.log2(F.col("perturbed_mean") / F.col("control_mean"))).withColumn("selected", F.lit(True)).withColumn("direct_target", F.col("affected_gene") % 5 == 0)
    seen = fx.visible_effects(full, 0.07).groupBy("status").agg(F.count("*").alias("n_visible"))
    return full.groupBy("status").agg(F.count("*").alias("n")).join(seen, "status", "left").na.fill(0, ["n_visible"])
