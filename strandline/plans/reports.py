"""Report table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators import reports
from strandline.plans.frames import read
from strandline.plans.registry import query

UP = "up AS (SELECT l_linenumber AS cluster, l_suppkey % 9 AS source, l_partkey % 25 AS middle, sum(l_discount - 0.05) AS up FROM lineitem GROUP BY 1, 2, 3), down AS (SELECT l_linenumber AS cluster, l_partkey % 25 AS middle, l_orderkey % 30 AS gene, sum(l_tax) AS down FROM lineitem GROUP BY 1, 2, 3)"


@query(f"WITH {UP} SELECT cluster, source, gene, count(*) AS n_middles, round(sum(sqrt(abs(up * down))), 4) AS strength FROM up JOIN down USING (cluster, middle) GROUP BY 1, 2, 3")
def indirect_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream and downstream parts joined by their middle."""
    line = read(spark, sf_dir, "lineitem")
    cluster, middle = F.col("l_linenumber").alias("cluster"), (F.col("l_partkey") % 25).alias("middle")
    up = line.select(cluster, (F.col("l_suppkey") % 9).alias("source"), middle, F.expr("l_discount - 0.05D").alias("weight"))
    down = line.select(cluster, middle, (F.col("l_orderkey") % 30).alias("gene"), F.col("l_tax").alias("weight"))
    return reports.indirect_routes(up, down).groupBy("cluster", "source", "gene").agg(F.count("*").alias("n_middles"), F.round(F.sum("strength"), 4).alias("strength"))


@query("""WITH a AS (SELECT DISTINCT l_linenumber AS cluster, l_partkey % 300 AS gene FROM lineitem WHERE l_quantity > 20), d AS (SELECT DISTINCT l_linenumber, l_partkey % 300 FROM lineitem WHERE l_discount > 0.08), r AS (SELECT DISTINCT l_linenumber, l_partkey % 300 FROM lineitem WHERE l_tax > 0.06)
SELECT cluster, gene FROM a WHERE (cluster, gene) NOT IN (SELECT * FROM d) AND (cluster, gene) IN (SELECT * FROM r)""")
def purely_indirect_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    pick = lambda c: line.where(c).select(F.col("l_linenumber").alias("cluster"), (F.col("l_partkey") % 300).alias("gene")).distinct()
    return reports.purely_indirect(pick("l_quantity > 20"), pick("l_discount > 0.08"), pick("l_tax > 0.06"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS input_id, l_partkey AS target_id FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_suppkey AS input_id, l_partkey AS target_id FROM lineitem WHERE l_linestatus <> 'F')
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def topology_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations in one registry (closed items) and not in the other (all others)."""
    line = read(spark, sf_dir, "lineitem")
    pick = lambda c: line.where(c).select(F.col("l_suppkey").alias("input_id"), F.col("l_partkey").alias("target_id")).distinct()
    return reports.topology_differences(pick("l_linestatus = 'F'"), pick("l_linestatus <> 'F'"))


@query("""WITH o AS (SELECT c_nationkey AS cluster, o_custkey AS gene, min(year(o_orderdate)) AS bin FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT n_nationkey AS cluster, y AS bin FROM nation, range(1995, 2002) t(y))
SELECT b.cluster, CAST(b.bin AS INTEGER) AS bin, count(o.gene) AS n_so_far FROM b LEFT JOIN o ON o.cluster = b.cluster AND o.bin <= b.bin GROUP BY 1, 2""")
def cumulative_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have ordered by each year, empty nations and years kept."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    first = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("cluster"), F.col("o_custkey").alias("gene")).agg(F.min(F.year("o_orderdate")).alias("bin"))
    first = first.withColumn("bin", F.greatest("bin", F.lit(1995)))
    bins = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("bin"))
    return reports.cumulative_onsets(first, bins)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS source, l_orderkey AS gene FROM lineitem) SELECT source, gene, count(*) OVER (PARTITION BY gene) > 1 AS shared FROM e""")
def shared_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return reports.shared_targets(line.select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("gene")).distinct()).select("source", "gene", "shared")


@query("""SELECT l_suppkey % 40 AS peak_id, count(DISTINCT l_partkey % 80) AS n_genes, count(DISTINCT (l_partkey % 80, l_linenumber)) AS n_edges, round(avg(l_extendedprice), 4) AS baseline, round(avg(l_extendedprice * (1 - l_discount)), 4) AS perturbed, round(avg(l_extendedprice * (1 - l_discount)) - avg(l_extendedprice), 4) AS delta FROM lineitem GROUP BY 1""")
def peak_intervention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.avg(F.expr("l_extendedprice * (1 - l_discount)"))
    gene = F.col("l_partkey") % 80
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("peak_id")).agg(F.countDistinct(gene).alias("n_genes"), F.countDistinct(gene, "l_linenumber").alias("n_edges"), F.round(F.avg("l_extendedprice"), 4).alias("baseline"), F.round(after, 4).alias("perturbed"), F.round(after - F.avg("l_extendedprice"), 4).alias("delta"))


@query("""SELECT l_suppkey % 30 AS tf, l_partkey % 30 AS gene, l_linenumber AS lag, min(l_tax) AS least_p, min(l_discount) AS least_fdr, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def least_p_by_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 30).alias("tf"), (F.col("l_partkey") % 30).alias("gene"), F.col("l_linenumber").alias("lag")).agg(F.min("l_tax").alias("least_p"), F.min("l_discount").alias("least_fdr"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1) SELECT label, count(*) AS n FROM t GROUP BY 1""")
def last_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each id, counted."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("label"))
    return reports.keep_last(o, "id", "at", "label").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT context, n FROM (SELECT 'cluster_' || c_nationkey AS raw, regexp_replace('cluster_' || c_nationkey, '^cluster_', '') AS context, count(*) AS n FROM customer GROUP BY 1, 2) UNION ALL SELECT 'all', count(*) FROM customer""")
def context_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context tables concatenated with the whole, aliases reconciled."""
    c = read(spark, sf_dir, "customer")
    by = c.groupBy(names.cluster_id(F.concat(F.lit("cluster_"), "c_nationkey")).alias("context")).agg(F.count("*").alias("n"))
    return by.unionByName(c.agg(F.lit("all").alias("context"), F.count("*").alias("n")))


@query("""WITH g AS (SELECT c_mktsegment AS gene, sum(c_acctbal) AS delta FROM customer GROUP BY 1) (SELECT 'highest' AS kind, gene FROM g ORDER BY delta DESC, gene LIMIT 1) UNION ALL (SELECT 'lowest', gene FROM g ORDER BY delta, gene LIMIT 1)""")
def extreme_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets with the largest and the smallest effect."""
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("gene")).agg(F.sum("c_acctbal").alias("delta"))
    top = g.orderBy(F.desc("delta"), "gene").limit(1).select(F.lit("highest").alias("kind"), "gene")
    return top.unionByName(g.orderBy("delta", "gene").limit(1).select(F.lit("lowest").alias("kind"), "gene"))


@query("""WITH f AS (SELECT DISTINCT 'Tf' || l_suppkey AS tf, l_partkey AS peak_id FROM lineitem), s AS (SELECT DISTINCT 'TF' || s_suppkey AS symbol FROM supplier WHERE s_nationkey % 2 = 0) SELECT peak_id, tf FROM f WHERE upper(tf) IN (SELECT upper(symbol) FROM s)""")
def expressed_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments whose factor is expressed, whatever the case of its symbol."""
    from strandline.operators.motif import present_factors

    line = read(spark, sf_dir, "lineitem")
    a = line.select(F.col("l_partkey").alias("peak_id"), F.concat(F.lit("Tf"), "l_suppkey").alias("tf")).distinct()
    return present_factors(a, read(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.concat(F.lit("TF"), "s_suppkey").alias("symbol")))
