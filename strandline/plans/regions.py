"""Interval, identity, name and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators import network, regions
from strandline.plans.frames import GENE_TABLE, PEAK_TABLE, genes, peaks, read
from strandline.plans.registry import query

REQUESTS = """asked AS (SELECT l_orderkey * 8 + l_linenumber AS request_id, l_orderkey, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
requests AS (SELECT request_id, part % 20 AS chr, l_orderkey + (supp % 5) * 37 AS q_start, l_orderkey + (supp % 5) * 37 + 20 + part % 180 AS q_end FROM asked)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    asked = line.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_id"), "l_orderkey").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    start = F.col("l_orderkey") + (F.col("supp") % 5) * 37
    return asked.select("request_id", (F.col("part") % 20).alias("chr"), start.alias("q_start"), (start + 20 + F.col("part") % 180).alias("q_end"))


@query(f"""WITH {PEAK_TABLE}, {GENE_TABLE} SELECT peak_id, gene_id, tss - (start + "end") / 2 AS distance FROM peaks p JOIN genes g ON p.chr = g.chr AND tss >= (start + "end") / 2 - 2000 AND tss < (start + "end") / 2 + 2000""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks and genes within 2,000 bases, the upper end excluded."""
    pairs = regions.band_pairs(peaks(spark, sf_dir), genes(spark, sf_dir), 2000)
    return pairs.select("peak_id", "gene_id", (F.col("tss") - F.col("mid")).alias("distance"))


OVERLAP = 'o AS (SELECT request_id, peak_id, least("end", q_end) - greatest(start, q_start) AS overlap, start FROM requests r JOIN peaks p ON r.chr = p.chr AND start < q_end AND "end" > q_start), ov AS (SELECT request_id, peak_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY overlap DESC, start, peak_id) AS k FROM o) WHERE k = 1)'
NEAR = 'nr AS (SELECT request_id, m.p AS peak_id, m.d / 2 AS distance FROM (SELECT request_id, min({d: abs((start + "end") - (q_start + q_end)), p: peak_id}) AS m FROM requests r JOIN peaks p ON r.chr = p.chr GROUP BY 1))'


@query(f"WITH {PEAK_TABLE}, {REQUESTS}, {OVERLAP} SELECT * FROM ov")
def peak_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlap_match(requests(spark, sf_dir), peaks(spark, sf_dir), 500)


@query(f"WITH {PEAK_TABLE}, {REQUESTS}, {NEAR} SELECT request_id, peak_id, CAST(distance AS DOUBLE) AS distance FROM nr")
def peak_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.nearest_match(requests(spark, sf_dir), peaks(spark, sf_dir))


@query(f"""WITH {PEAK_TABLE}, {REQUESTS}, {OVERLAP}, {NEAR}, x AS (SELECT request_id, min(peak_id) AS peak_id FROM requests r JOIN peaks p ON r.chr = p.chr AND q_start = start AND q_end = "end" GROUP BY 1)
SELECT request_id, coalesce(x.peak_id, ov.peak_id, nr.peak_id) AS peak_id, CASE WHEN x.peak_id IS NOT NULL THEN 'exact' WHEN ov.peak_id IS NOT NULL THEN 'overlap' WHEN nr.peak_id IS NOT NULL THEN 'nearest' ELSE 'peak_not_found' END AS "match" FROM requests LEFT JOIN x USING (request_id) LEFT JOIN ov USING (request_id) LEFT JOIN nr USING (request_id)""")
def peak_match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.match_peaks(requests(spark, sf_dir), peaks(spark, sf_dir), 500, True)


REFERENCE = "ref AS (SELECT 'E' || p_partkey || '.1' AS ref_id, 'G' || p_partkey % 700 AS symbol FROM part)"


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("E"), "p_partkey", F.lit(".1")).alias("ref_id"), F.concat(F.lit("G"), F.col("p_partkey") % 700).alias("symbol"))


@query(f"""WITH {REFERENCE}, ids AS (SELECT 'E' || (l_partkey * 2) || '.' || l_linenumber AS raw_id FROM lineitem GROUP BY 1), n AS (SELECT raw_id, regexp_replace(raw_id, '\\.[0-9]+$', '') AS norm_id FROM ids)
SELECT raw_id, n.norm_id, symbol, CASE WHEN symbol IS NULL THEN 'not_in_reference' WHEN count(*) OVER (PARTITION BY n.norm_id) > 1 THEN 'duplicate_id' ELSE 'ok' END AS status FROM n LEFT JOIN (SELECT regexp_replace(ref_id, '\\.[0-9]+$', '') AS norm_id, symbol FROM ref) r ON r.norm_id = n.norm_id""")
def gene_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured ids, with versions, against the reference."""
    ids = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("E"), F.col("l_partkey") * 2, F.lit("."), "l_linenumber").alias("raw_id")).distinct()
    return regions.identify_genes(ids, reference(spark, sf_dir))


LABELS = "lab AS (SELECT ref_id, symbol, CASE WHEN count(*) OVER (PARTITION BY symbol) > 1 THEN symbol || '_' || lpad(CAST(row_number() OVER (PARTITION BY symbol ORDER BY ref_id) AS VARCHAR), 2, '0') ELSE symbol END AS label FROM ref)"


@query(f"WITH {REFERENCE}, {LABELS} SELECT * FROM lab")
def gene_display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.display_labels(reference(spark, sf_dir))


@query(f"""WITH {REFERENCE}, {LABELS}, tok AS (SELECT DISTINCT CASE l_suppkey % 4 WHEN 0 THEN 'E' || l_partkey || '.1' WHEN 1 THEN 'E' || l_partkey || '.7' WHEN 2 THEN 'G' || l_partkey % 700 || '_01' ELSE 'g' || l_partkey % 900 END AS token FROM lineitem),
j AS (SELECT token, r.ref_id AS a, n.ref_id AS b, l.ref_id AS c, s.one AS d, s.n FROM tok LEFT JOIN ref r ON r.ref_id = token LEFT JOIN (SELECT regexp_replace(ref_id, '\\.[0-9]+$', '') AS k, min(ref_id) AS ref_id FROM ref GROUP BY 1) n ON n.k = regexp_replace(token, '\\.[0-9]+$', '') LEFT JOIN (SELECT label, min(ref_id) AS ref_id FROM lab GROUP BY 1) l ON l.label = token LEFT JOIN (SELECT lower(symbol) AS s, min(ref_id) AS one, count(*) AS n FROM ref GROUP BY 1) s ON s.s = lower(token))
SELECT token, coalesce(a, b, c, CASE WHEN n = 1 THEN d END) AS ref_id, CASE WHEN coalesce(a, b, c, CASE WHEN n = 1 THEN d END) IS NOT NULL THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM j""")
def gene_token_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, versioned ids, labels and symbols in any case to reference ids."""
    line = read(spark, sf_dir, "lineitem")
    kind, part = F.col("l_suppkey") % 4, F.col("l_partkey")
    token = F.when(kind == 0, F.concat(F.lit("E"), part, F.lit(".1"))).when(kind == 1, F.concat(F.lit("E"), part, F.lit(".7"))).when(kind == 2, F.concat(F.lit("G"), part % 700, F.lit("_01"))).otherwise(F.concat(F.lit("g"), part % 900))
    return regions.resolve_tokens(line.select(token.alias("token")).distinct(), reference(spark, sf_dir))


@query(f"WITH {REFERENCE}, s AS (SELECT DISTINCT 'g' || s_suppkey AS symbol FROM supplier) SELECT s.symbol, ref_id FROM s JOIN ref ON lower(ref.symbol) = s.symbol")
def factor_symbol_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.expand_symbols(read(spark, sf_dir, "supplier").select(F.concat(F.lit("g"), "s_suppkey").alias("symbol")).distinct(), reference(spark, sf_dir))


@query("""WITH n AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'chr' || o_custkey % 20 || ':' || o_orderkey || '-' || (o_orderkey + 200) WHEN 1 THEN 'chr' || o_custkey % 20 || '-' || o_orderkey || '-' || (o_orderkey + 200) ELSE 'MT-ND' || o_custkey % 9 END AS name, o_custkey % 2 = 0 AS plus FROM orders),
p AS (SELECT *, nullif(regexp_extract(name, '^([^:]+?)[:-]([0-9]+)-([0-9]+)$', 1), '') AS chr, CAST(nullif(regexp_extract(name, '^([^:]+?)[:-]([0-9]+)-([0-9]+)$', 2), '') AS BIGINT) AS s, CAST(nullif(regexp_extract(name, '^([^:]+?)[:-]([0-9]+)-([0-9]+)$', 3), '') AS BIGINT) AS e FROM n)
SELECT id, chr, s AS start, e AS stop, CASE WHEN chr IS NULL THEN 'Gene Expression' ELSE 'Peaks' END AS feature_type, upper(name) LIKE 'MT-%' AS mitochondrial, CASE WHEN plus THEN s ELSE e - 1 END AS tss FROM p""")
def peak_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak names in both notations, feature types, mitochondrial genes, strand-aware starts."""
    o, kind, cust, key = read(spark, sf_dir, "orders"), F.col("o_custkey") % 3, F.col("o_custkey"), F.col("o_orderkey")
    name = F.when(kind < 2, F.concat(F.lit("chr"), cust % 20, F.when(kind == 0, ":").otherwise("-"), key, F.lit("-"), key + 200)).otherwise(F.concat(F.lit("MT-ND"), cust % 9))
    p = o.select(key.alias("id"), name.alias("name"), F.when(cust % 2 == 0, "+").otherwise("-").alias("strand"))
    p = p.select("*", names.peak_part(F.col("name"), 1).alias("chr"), names.peak_part(F.col("name"), 2).cast("long").alias("start"), names.peak_part(F.col("name"), 3).cast("long").alias("stop"))
    return p.select("id", "chr", "start", "stop", names.feature_type(F.col("name")).alias("feature_type"), F.upper("name").like("MT-%").alias("mitochondrial"), names.tss(F.col("strand"), F.col("start"), F.col("stop")).alias("tss"))


@query("""SELECT o_orderkey, replace(replace('chr' || o_custkey % 20 || ':1,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '–2,000', ',', ''), '–', '-') AS plain, upper(regexp_replace(lower(replace(o_orderpriority, '-', '')) || o_custkey, '[0-9]+$', '')) AS root, o_orderstatus = 'F' AS flag FROM orders""")
def name_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate requests, root names and textual flags of every order."""
    o = read(spark, sf_dir, "orders")
    asked = F.concat(F.lit("chr"), F.col("o_custkey") % 20, F.lit(":1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("–2,000"))
    symbol = F.concat(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(""))), "o_custkey")
    flag = F.when(F.col("o_orderstatus") == "F", " True ").otherwise("no")
    return o.select("o_orderkey", names.plain_coordinates(asked).alias("plain"), names.root_name(symbol).alias("root"), names.strict_flag(flag).alias("flag"))


EDGES = "edges AS (SELECT DISTINCT l_partkey AS src, 1000000000000 + l_orderkey AS dst FROM lineitem UNION SELECT DISTINCT 1000000000000 + l_orderkey, l_suppkey FROM lineitem)"


def regulatory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of genes (parts, suppliers) and peaks (orders, from 10**12)."""
    line = read(spark, sf_dir, "lineitem")
    peak = (1000000000000 + F.col("l_orderkey")).alias("peak")
    return line.select(F.col("l_partkey").alias("src"), peak.alias("dst")).union(line.select(peak, "l_suppkey")).distinct()


@query(f"""WITH RECURSIVE {EDGES}, walk(node, depth) AS (SELECT CAST(x AS BIGINT), 0 FROM range(5) t(x) UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 5) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1""")
def regulatory_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached from five genes, alternating genes and peaks, within five rounds."""
    return network.closure(regulatory_edges(spark, sf_dir), spark.range(5).select(F.col("id").alias("node")), 5)


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders), u AS (SELECT src AS a, coalesce(dst, src) AS b FROM o UNION SELECT dst, src FROM o WHERE dst IS NOT NULL),
walk(a, b) AS (SELECT a, a FROM u UNION SELECT w.a, u.b FROM walk w JOIN u ON w.b = u.a) SELECT a AS node, min(b) AS component FROM walk GROUP BY 1""")
def network_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all orders, each linked with its customer's next one."""
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), nxt.alias("dst"))
    return network.components(chain.withColumn("dst", F.coalesce("dst", "src")))


@query("""WITH tp AS (SELECT DISTINCT l_partkey AS tf, l_suppkey AS peak FROM lineitem), pg AS (SELECT DISTINCT l_suppkey AS peak, l_orderkey AS gene FROM lineitem),
own AS (SELECT * FROM tp WHERE tf IN (1, 2)), down AS (SELECT * FROM pg WHERE peak IN (SELECT peak FROM own) AND gene < 3000)
SELECT tf AS src, peak AS dst, 'target_peak' AS layer FROM own WHERE peak IN (SELECT peak FROM down) UNION ALL SELECT peak, gene, 'peak_gene' FROM down UNION ALL SELECT tf, peak, 'factor_peak' FROM tp WHERE tf NOT IN (1, 2) AND peak IN (SELECT peak FROM down)""")
def network_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    tp = line.select(F.col("l_partkey").alias("tf"), F.col("l_suppkey").alias("peak")).distinct()
    pg = line.select(F.col("l_suppkey").alias("peak"), F.col("l_orderkey").alias("gene")).distinct()
    return network.layered_subgraph(tp, pg, spark.range(1, 3).select(F.col("id").alias("gene")), spark.range(3000).select(F.col("id").alias("gene")))


@query("""WITH c AS (SELECT c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT c_nationkey AS s, s_nationkey AS d, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey < s_nationkey GROUP BY 1, 2)
SELECT (SELECT count(*) FROM c) AS n_nodes, count(*) AS n_edges, count(DISTINCT s) AS n_sources FROM w""")
def network_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct nodes and edges of the cluster graph."""
    c, w = cluster_graph(spark, sf_dir)
    return w.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources")).crossJoin(c.agg(F.count("*").alias("n_nodes"))).select("n_nodes", "n_edges", "n_sources")


def cluster_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    o, line, s = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    pairs = o.join(c, o.o_custkey == c.c_custkey).join(line, line.l_orderkey == o.o_orderkey).join(s, s.s_suppkey == line.l_suppkey).where("c_nationkey < s_nationkey")
    w = pairs.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return c.groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count("*").alias("n_cells")), w


@query()
def cluster_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages of clusters by connectivity above three quarters of all, small ones merged."""
    sizes, w = cluster_graph(spark, sf_dir)
    cut = w.agg(F.percentile("weight", 0.97)).first()[0] or 0.0
    least = (sizes.agg(F.percentile("n_cells", 0.5)).first()[0] or 1) * 2
    return network.lineages(w, sizes, cut, int(least))
