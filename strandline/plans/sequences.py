"""Motif, projection, hash and text queries over documents, embeddings, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import families, motif, projection
from strandline.plans.frames import atac, read, rna
from strandline.plans.registry import query
from strandline.storage import written

# Three small count matrices (rows A, C, G, T) for the scan queries.
MOTIFS = [
    ("M1", "TF1::TF2", [[8.0, 0.0, 1.0, 1.0], [0.0, 9.0, 1.0, 0.0], [1.0, 0.0, 8.0, 1.0], [0.0, 1.0, 0.0, 9.0]], True),
    ("M2", "TF3", [[1.0, 1.0, 7.0, 1.0], [9.0, 0.0, 0.0, 1.0], [2.0, 3.0, 2.0, 3.0], [0.0, 0.0, 10.0, 0.0], [5.0, 5.0, 0.0, 0.0]], False),
    ("M3", "TF1", [[0.0, 10.0, 0.0, 0.0], [10.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 10.0]], False),
]
MOTIF_SQL = "motifs AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', {c}, {str(k).lower()})" for i, t, c, k in MOTIFS) + ") v(motif_id, tf_names, counts, curated))"
PWM_SQL = "pwms AS (SELECT motif_id, tf_names, list_transform(counts, lambda r: list_transform(r, lambda x: log2((CAST(x AS DOUBLE) + 0.01) / (CAST(list_sum(r) AS DOUBLE) + 0.04) / 0.25))) AS pwm FROM motifs)"
#: Each letter of a text stands for a base, n and all else for a masked one.
LETTERS = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c != "n")
BASES = "".join("ACGT"[k * 7 % 13 % 4] for k in range(len(LETTERS)))
SEQ_SQL = f"seqs AS (SELECT doc_id AS peak_id, translate(regexp_replace(text, '[^A-Za-z]', 'n', 'g'), '{LETTERS}{LETTERS.upper()}', '{BASES}{BASES}') AS seq FROM documents)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all whole texts that both engines derive alike."""
    seq = F.translate(F.regexp_replace("text", "[^A-Za-z]", "n"), LETTERS + LETTERS.upper(), BASES * 2)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("peak_id"), seq.alias("seq"))


def motifs(spark: SparkSession) -> DataFrame:
    m = spark.createDataFrame(MOTIFS, "motif_id string, tf_names string, counts array<array<double>>, curated boolean")
    return m.withColumn("pwm", motif.log_odds(F.col("counts"))).withColumn("information", motif.information(F.col("counts")))


HITS = f"""{MOTIF_SQL}, {PWM_SQL}, {SEQ_SQL}, w AS (SELECT peak_id, motif_id, list_transform(range(1, len(seq) - len(pwm) + 2), lambda i: CASE WHEN regexp_matches(substr(seq, CAST(i AS BIGINT), len(pwm)), '^[ACGT]*$') THEN list_sum(list_transform(range(1, len(pwm) + 1), lambda j: pwm[j][strpos('ACGT', substr(seq, CAST(i + j - 1 AS BIGINT), 1))])) END) AS w FROM seqs CROSS JOIN pwms),
m AS (SELECT peak_id, motif_id, list_max(w) AS best, list_avg(w) AS mean, list_stddev_pop(w) AS sd FROM w), h AS (SELECT *, greatest(0, least(1, 1 - exp(-exp(-(best - (mean - 0.5772156649015329 * sd * sqrt(6) / pi())) / (sd * sqrt(6) / pi()))))) AS p_value FROM m WHERE sd > 1e-9), hits AS (SELECT * FROM h WHERE p_value < 0.05)"""


@query(f"WITH {HITS} SELECT peak_id, motif_id, round(best, 6) AS best, round(p_value, 6) AS p_value FROM hits")
def motif_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = motif.scan(sequences(spark, sf_dir), motifs(spark), 0.05)
    return hits.select("peak_id", "motif_id", F.round("best", 6).alias("best"), F.round("p_value", 6).alias("p_value"))


ASSIGNED = "n AS (SELECT motif_id, unnest(string_split(tf_names, '::')) AS tf FROM motifs), b AS (SELECT peak_id, tf, min(p_value) AS p FROM hits JOIN n USING (motif_id) GROUP BY 1, 2)"


@query(f"WITH {HITS}, {ASSIGNED} SELECT peak_id, tf, round(p, 6) AS p_value FROM b")
def factor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of peaks by their best motif hit."""
    m = motifs(spark)
    a = motif.assign_factors(motif.scan(sequences(spark, sf_dir), m, 0.05), m)
    return a.select("peak_id", "tf", F.round("p_value", 6).alias("p_value"))


@query(f"WITH {HITS}, {ASSIGNED}, seen AS (SELECT DISTINCT peak_id FROM b WHERE tf IN ('TF2', 'TF3')) SELECT peak_id, 'TF1' AS tf FROM seen WHERE peak_id NOT IN (SELECT peak_id FROM b WHERE tf = 'TF1')")
def factor_family_borrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks where a family member of TF1 binds and TF1 itself was not found."""
    m = motifs(spark)
    a = motif.assign_factors(motif.scan(sequences(spark, sf_dir), m, 0.05), m)
    family = motif.families(m.select(F.explode(F.split("tf_names", "::")).alias("tf")).distinct())
    return motif.borrow_family(a, family, spark.createDataFrame([("TF1",)], "tf string"))


@query(f"""WITH {HITS}, n AS (SELECT motif_id, string_split(tf_names, '::') AS names FROM motifs), t AS (SELECT DISTINCT unnest(names) AS tf FROM n), a AS (SELECT DISTINCT peak_id, unnest(names) AS tf FROM hits JOIN n USING (motif_id) WHERE p_value < 0.01),
x AS (SELECT peak_id, t.tf, 1 AS k FROM a JOIN t ON t.tf <> a.tf UNION SELECT peak_id, t.tf, 2 FROM hits JOIN n USING (motif_id) JOIN t ON NOT list_contains(names, t.tf))
SELECT peak_id, tf, CASE min(k) WHEN 1 THEN 'passive' ELSE 'active' END AS way FROM x WHERE (peak_id, tf) NOT IN (SELECT (peak_id, tf) FROM a) GROUP BY 1, 2""")
def factor_family_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that each factor gains from its family: members assigned below 0.01, or a matrix of another member below 0.05."""
    m = motifs(spark)
    assigned = written(motif.assign_factors(motif.scan(sequences(spark, sf_dir), m, 0.01), m), "assigned")
    targets = families.named_factors(m).select("tf").distinct()
    evidence = families.scan_families(sequences(spark, sf_dir), m, targets, 0.05, 3)
    return families.family_additions(assigned, evidence, m, targets)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS peak_id, 'G' || l_partkey AS gene FROM lineitem), t AS (SELECT DISTINCT 'G' || s_suppkey AS tf FROM supplier)
SELECT peak_id, gene AS tf, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY gene) AS rk FROM l WHERE gene IN (SELECT tf FROM t)) WHERE rk <= 5""")
def factor_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("peak_id"), F.concat(F.lit("G"), "l_partkey").alias("gene"))
    return motif.fallback_factors(links, read(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("tf")).distinct())


KNN = "q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q_id, vec_id AS r_id, label, sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: pow(CAST(q[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2)))) AS distance FROM q, embeddings e WHERE q_id <> vec_id), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, r_id) AS rk FROM d) WHERE rk <= 10)"


def near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    found = projection.neighbours(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("vec")), 11).where("q_id <> r_id")
    order = Window.partitionBy("q_id").orderBy("distance", "r_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 10"), e


@query(f"WITH {KNN} SELECT q_id, r_id, round(distance, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM knn")
def reference_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of every hundredth vector."""
    return near(spark, sf_dir)[0].select("q_id", "r_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {KNN}, g AS (SELECT q_id, label AS branch, sum(1 / (distance + 1e-9)) AS w, sum(r_id / (distance + 1e-9)) / sum(1 / (distance + 1e-9)) AS t FROM knn GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY q_id) AS p FROM g),
b AS (SELECT q_id, arg_max(branch, (round(p, 9), -branch)) AS branch, max(p) AS probability, sum(-p * ln(p)) AS entropy, arg_max(t, (round(p, 9), -branch)) AS t FROM p GROUP BY 1)
SELECT q_id, branch, round(probability, 6) AS probability, round(entropy, 6) + 0.0 AS entropy, CASE WHEN probability < 0.6 OR entropy > 0.5 * ln(10) THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN NOT (probability < 0.6 OR entropy > 0.5 * ln(10)) THEN round(t, 5) END AS pseudotime FROM b""")
def branch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch probabilities of queries, with the label as branch and the id as time."""
    n, e = near(spark, sf_dir)
    p = projection.project_branches(n, e.select(F.col("vec_id").alias("r_id"), F.col("label").alias("branch"), F.col("vec_id").cast("double").alias("pseudotime")), 10)
    return p.select("q_id", "branch", F.round("probability", 6).alias("probability"), (F.round("entropy", 6) + 0.0).alias("entropy"), "status", F.round("pseudotime", 5).alias("pseudotime"))


@query(f"""WITH {KNN.replace("WHERE q_id <> vec_id", "WHERE vec_id % 100 <> 0")}, r AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 <> 0),
o AS (SELECT a.vec_id, min(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))))) AS distance FROM r a, r b WHERE a.vec_id <> b.vec_id GROUP BY 1),
c AS (SELECT quantile_cont(distance, 0.99) AS cut FROM o), u AS (SELECT count(DISTINCT label) AS n FROM embeddings WHERE vec_id % 100 <> 0),
g AS (SELECT q_id, label AS branch, sum(1 / (distance + 1e-9)) AS w, sum(r_id / (distance + 1e-9)) / sum(1 / (distance + 1e-9)) AS t, min(distance) AS d FROM knn GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY q_id) AS p FROM g),
b AS (SELECT q_id, arg_max(branch, (round(p, 9), -branch)) AS branch, max(p) AS probability, sum(-p * ln(p)) AS entropy, arg_max(t, (round(p, 9), -branch)) AS t, min(d) AS d FROM p GROUP BY 1),
s AS (SELECT q_id, branch, probability, t, d / cut AS score, d > cut AS far, probability < 0.6 OR entropy > 0.5 * ln(greatest(n, 2)) AS unclear FROM b, c, u)
SELECT q_id, CASE WHEN NOT far AND NOT unclear THEN branch END AS branch, CASE WHEN NOT far AND NOT unclear THEN round(t, 5) END AS pseudotime, round(probability, 6) AS probability, round(score, 6) AS score, CASE WHEN far AND unclear THEN 'ood_and_ambiguous' WHEN far THEN 'ood' WHEN unclear THEN 'ambiguous' ELSE 'ok' END AS status FROM s""")
def frozen_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector on a reference of all others with frozen thresholds; the axes span everything, so distances decide."""
    e = read(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    reference, placed = projection.fit_reference(vectors.where("id % 100 <> 0"))
    labels = e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("r_id"), F.col("label").alias("branch"), F.col("vec_id").cast("double").alias("pseudotime"))
    p = projection.project_reference(reference, placed, labels, vectors.where("id % 100 = 0"))
    return p.select("q_id", "branch", F.round("pseudotime", 5).alias("pseudotime"), F.round("probability", 6).alias("probability"), F.round("score", 6).alias("score"), "status")


@query()
def principal_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five principal coordinates of every vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return projection.principal_components(e, 5).select("id", "coords")


@query("SELECT event_type, count(*) AS n, min(sha256(CAST(event_id AS VARCHAR) || '|' || event_type)) AS first_hash, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of rows, and a JSON attribute."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min(F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)).alias("first_hash"), F.sum(k).alias("k_sum"))


@query("""WITH s AS (SELECT event_id, value / 10 - 5 AS z FROM events) SELECT event_id, round(z / (1 + abs(z)), 8) + 0.0 AS soft, round(1 / (1 + exp(-z)), 8) AS sigma, round(ln(greatest(1e-4, least(1 - 1e-4, 1 / (1 + exp(-z)))) / (1 - greatest(1e-4, least(1 - 1e-4, 1 / (1 + exp(-z)))))), 6) + 0.0 AS back, round(least(greatest(z, -2), 2), 8) + 0.0 AS cut FROM s""")
def link_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("value") / 10 - 5
    s = stats.logistic(z)
    return read(spark, sf_dir, "events").select("event_id", (F.round(stats.softsign(z), 8) + 0.0).alias("soft"), F.round(s, 8).alias("sigma"), (F.round(stats.logit(s), 6) + 0.0).alias("back"), (F.round(stats.clip(z, -2.0, 2.0), 8) + 0.0).alias("cut"))


@query("""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, round(CASE WHEN value < lo + (hi - lo) / 4 THEN (lo + (hi - lo) / 4 - value) / (hi - lo) WHEN value > hi - (hi - lo) / 4 THEN (value - hi + (hi - lo) / 4) / (hi - lo) ELSE 0 END, 6) + 0.0 AS distance, round(hi + 0.25 * (hi - lo), 6) AS upper_bound FROM events JOIN b USING (event_type)""")
def support_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance outside the inner range in units of the range, and the output bound of each type."""
    e = read(spark, sf_dir, "events")
    b = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.col("hi") - F.col("lo")
    low, high = F.col("lo") + span / 4, F.col("hi") - span / 4
    d = F.when(F.col("value") < low, (low - F.col("value")) / F.when(span > 0, span)).when(F.col("value") > high, (F.col("value") - high) / F.when(span > 0, span)).otherwise(0.0)
    return e.join(F.broadcast(b), "event_type").select("event_id", (F.round(d, 6) + 0.0).alias("distance"), F.round(F.col("hi") + 0.25 * span, 6).alias("upper_bound"))


@query("""SELECT source, lang, count(*) AS n, grouping(source) + 2 * grouping(lang) AS level FROM documents GROUP BY CUBE (source, lang)""")
def source_language_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").cube("source", "lang").agg(F.count("*").alias("n"), (F.grouping("source").cast("long") + 2 * F.grouping("lang").cast("long")).alias("level"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT role, count(*) AS n_turns, count(*) FILTER (before = role) AS repeats, CAST(sum(n) AS BIGINT) AS chars FROM t GROUP BY 1""")
def turn_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.when(F.col("before") == F.col("role"), 1).otherwise(0)).cast("long").alias("repeats"), F.sum(F.length("text")).alias("chars"))


@query()
def joint_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five coordinates a modality of all cells with both, each modality of the same total size."""
    e, a = rna(spark, sf_dir), atac(spark, sf_dir)
    cells = e.select("cell_id").intersect(a.select("cell_id"))
    v = [written(projection.variable_vectors(t, cells), "vectors") for t in (e, a)]
    return projection.joint_embedding(*v, 5)
