"""The analytics model over the driver's tables, as frames and as SQL.

Orders are cells: their day is the pseudotime and the customer's number modulo 3 the branch. Line items give
expression (quantity of a part class in an order) and accessibility (line numbers of a supplier class). Orders
also give peaks and parts genes on 20 chromosomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES, PEAKS, BRANCHES = 40, 60, 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01")).cast("double")
    return o.select(F.col("o_orderkey").alias("cell_id"), day.alias("pseudotime"), (F.col("o_custkey") % BRANCHES).alias("branch"))


def rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("cell_id"), (F.col("l_partkey") % GENES).alias("feature_id")).agg(F.sum("l_quantity").alias("value"))


def atac(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("cell_id"), (F.col("l_suppkey") % PEAKS).alias("feature_id")).agg(F.sum("l_linenumber").cast("double").alias("value"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("peak_id"), (F.col("o_custkey") % 20).alias("chr"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 200 + F.col("o_custkey") % 2).alias("end"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"), (F.col("p_partkey") % 20).alias("chr"), (F.col("p_partkey") * 7).alias("tss"))


def gene_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the features of rna."""
    f = read(spark, sf_dir, "part").select((F.col("p_partkey") % GENES).alias("gene")).distinct()
    return f.select("gene", (F.col("gene") % 4).alias("chr"), (F.col("gene") * 1000 + 137).alias("tss"))


def peak_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the features of atac."""
    f = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % PEAKS).alias("peak")).distinct()
    return f.select("peak", (F.col("peak") % 4).alias("chr"), (F.col("peak") * 700).alias("start"), (F.col("peak") * 700 + 301).alias("end"))


#: Distance of a candidate peak from a gene's start.
BAND = 12_000
LOCI = f"""candidates AS (SELECT gene, peak FROM (SELECT DISTINCT p_partkey % {GENES} AS gene FROM part) g, (SELECT DISTINCT s_suppkey % {PEAKS} AS peak FROM supplier) p
WHERE gene % 4 = peak % 4 AND gene * 1000 + 137 >= peak * 700 + 150.5 - {BAND} AND gene * 1000 + 137 < peak * 700 + 150.5 + {BAND})"""
CELLS = f"cells AS (SELECT o_orderkey AS cell_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS pseudotime, o_custkey % {BRANCHES} AS branch FROM orders)"
RNA = f"rna AS (SELECT l_orderkey AS cell_id, l_partkey % {GENES} AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
ATAC = f"atac AS (SELECT l_orderkey AS cell_id, l_suppkey % {PEAKS} AS feature_id, CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"
PEAK_TABLE = "peaks AS (SELECT o_orderkey AS peak_id, o_custkey % 20 AS chr, o_orderkey AS start, o_orderkey + 200 + o_custkey % 2 AS \"end\" FROM orders)"
GENE_TABLE = "genes AS (SELECT p_partkey AS gene_id, p_name AS symbol, p_partkey % 20 AS chr, p_partkey * 7 AS tss FROM part)"


def bins_sql(n: int) -> str:
    """Equal-frequency bins of cells in n quantiles by branch, right-closed."""
    cuts = ", ".join(repr(k / n) for k in range(n + 1))
    return f"""edges AS (SELECT branch, list_sort(list_distinct(quantile_cont(pseudotime, [{cuts}]))) AS e FROM cells GROUP BY branch),
binned AS (SELECT c.*, CAST(len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x < pseudotime)) AS INTEGER) AS bin FROM cells c JOIN edges USING (branch))"""


def means_sql(entries: str, out: str) -> str:
    return f"""{out}_n AS (SELECT branch, bin, count(*) AS n FROM binned GROUP BY 1, 2),
{out}_s AS (SELECT branch, bin, feature_id, sum(value) AS s FROM {entries} JOIN binned USING (cell_id) GROUP BY 1, 2, 3),
{out} AS (SELECT n.branch, n.bin, f.feature_id, coalesce(s.s, 0) / n.n AS value FROM {out}_n n CROSS JOIN (SELECT DISTINCT feature_id FROM {entries}) f LEFT JOIN {out}_s s ON s.branch = n.branch AND s.bin = n.bin AND s.feature_id = f.feature_id)"""


def tail_sql(f: str, d: str) -> str:
    """P(F(1, d) >= f) for whole d."""
    c2 = f"(({d}) / (({d}) + ({f})))"
    s = f"sqrt(greatest(1 - {c2}, 0))"
    odd = f"1 - 2 / pi() * (asin({s}) + CASE WHEN {d} < 3 THEN 0 ELSE {s} * list_sum(list_transform(range(0, CAST(({d} - 3) / 2 AS BIGINT) + 1), lambda k: sqrt({c2}) * pow({c2}, k) * exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2)) END)"
    even = f"1 - {s} * list_sum(list_transform(range(0, CAST({d} / 2 AS BIGINT)), lambda k: pow({c2}, k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi())))"
    return f"greatest(0, least(1, CASE WHEN CAST({d} AS BIGINT) % 2 = 1 THEN {odd} ELSE {even} END))"
