"""Quality control, normalisation, binning and screening queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import binning, planned, qc, regions, screening
from strandline.plans.frames import ATAC, BAND, CELLS, GENES, LOCI, PEAKS, RNA, atac, bins_sql, cells, gene_loci, means_sql, peak_loci, read, rna, tail_sql
from strandline.plans.registry import query
from strandline.storage import written


@query(f"""WITH {RNA}, kept AS (SELECT feature_id FROM rna GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 20),
e AS (SELECT * FROM rna WHERE feature_id IN (SELECT feature_id FROM kept)), ok AS (SELECT cell_id FROM e GROUP BY 1 HAVING sum(value) >= 60)
SELECT feature_id, count(*) AS n_cells, round(sum(value), 4) AS total FROM e WHERE cell_id IN (SELECT cell_id FROM ok) GROUP BY 1""")
def qc_gene_cell_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in enough cells, then cells with enough counts."""
    kept = qc.filter_entries(rna(spark, sf_dir), 20, 60.0)
    return kept.groupBy("feature_id").agg(F.count("*").alias("n_cells"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {RNA}, n AS (SELECT feature_id, count(*) FILTER (value > 0) AS n_cells FROM rna GROUP BY 1), m AS (SELECT CAST(floor(median(n_cells)) AS BIGINT) AS lim FROM n)
SELECT feature_id, n_cells, n_cells < lim AS rescued FROM n, m WHERE n_cells >= lim OR (n_cells > 0 AND feature_id % 7 = 0)""")
def qc_required_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested features kept below the detection limit (here the median of detections)."""
    e = rna(spark, sf_dir)
    limit = int(e.groupBy("feature_id").agg(F.sum((F.col("value") > 0).cast("long")).alias("n")).agg(F.percentile("n", 0.5)).first()[0])
    return qc.detected_features(e, limit, e.select("feature_id").distinct().where("feature_id % 7 = 0"))


@query(f"""WITH {ATAC}, one AS (SELECT * FROM atac WHERE value > 0), p AS (SELECT feature_id FROM one GROUP BY 1 HAVING count(*) >= 15), k AS (SELECT * FROM one WHERE feature_id IN (SELECT feature_id FROM p)),
c AS (SELECT cell_id FROM k GROUP BY 1 HAVING count(*) >= 3)
SELECT feature_id, CAST(sum(1.0) AS DOUBLE) AS accessible FROM k WHERE cell_id IN (SELECT cell_id FROM c) GROUP BY 1""")
def qc_atac_binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.binarise(atac(spark, sf_dir), 15, 3).groupBy("feature_id").agg(F.sum("value").alias("accessible"))


@query(f"""WITH {RNA}, {ATAC}, g AS (SELECT cell_id, count(*) AS n_genes FROM rna WHERE value > 0 GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT cell_id, count(*) AS n_peaks FROM atac WHERE value > 0 GROUP BY 1 HAVING count(*) >= 4)
SELECT cell_id, n_genes, n_peaks FROM g JOIN p USING (cell_id)""")
def qc_joint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.joint_cells(rna(spark, sf_dir), atac(spark, sf_dir), 3, 4)


@query(f"""WITH {RNA}, {CELLS} SELECT count(*) AS n_common FROM (SELECT DISTINCT cell_id FROM rna INTERSECT SELECT cell_id FROM cells)""")
def cell_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on both axes."""
    return rna(spark, sf_dir).select("cell_id").distinct().join(cells(spark, sf_dir), "cell_id", "left_semi").agg(F.count("*").alias("n_common"))


@query(f"""WITH {RNA}, t AS (SELECT cell_id, sum(value) AS t FROM rna GROUP BY 1)
SELECT feature_id, count(*) AS n, round(sum(ln(1 + 10000 * value / t)), 4) AS total FROM rna JOIN t USING (cell_id) GROUP BY 1""")
def normalise_log_cp10k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.log_cp10k(rna(spark, sf_dir)).groupBy("feature_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {ATAC}, d AS (SELECT cell_id, sum(value) AS d FROM atac GROUP BY 1)
SELECT feature_id, round(sum(ln(1 + 10000 * value / d)), 4) AS total FROM atac JOIN d USING (cell_id) WHERE feature_id % 2 = 0 GROUP BY 1""")
def normalise_atac_full_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth over all peaks, although only half of them are kept."""
    a = atac(spark, sf_dir)
    return qc.depth_log1p(a.where("feature_id % 2 = 0"), a).groupBy("feature_id").agg(F.round(F.sum("value"), 4).alias("total"))


VARIANCE = f"n AS (SELECT count(*) AS n FROM cells), mv AS (SELECT feature_id, sum(value) / n AS mean, greatest(sum(value * value) / n - pow(sum(value) / n, 2), 0) AS variance FROM rna, n GROUP BY feature_id, n)"


@query(f"""WITH {RNA}, {CELLS}, {VARIANCE} SELECT feature_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM mv WHERE variance > 0 ORDER BY variance DESC, feature_id LIMIT 12""")
def variable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cells(spark, sf_dir).count()
    top = qc.most_variable(qc.feature_moments(rna(spark, sf_dir), n), 12)
    return top.select("feature_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"""WITH {RNA}, {CELLS}, {VARIANCE}, l AS (SELECT *, ln(variance / mean) AS dispersion, ln(1 + mean) AS lm FROM mv WHERE mean > 0 AND variance > 0), s AS (SELECT min(lm) AS lo, max(lm) AS hi FROM l),
b AS (SELECT l.*, least(floor((lm - lo) / (hi - lo) * 5), 4) AS band FROM l, s), m AS (SELECT band, avg(dispersion) AS m, stddev_pop(dispersion) AS sd FROM b GROUP BY 1)
SELECT feature_id, round(CASE WHEN sd > 1e-12 THEN (dispersion - m) / sd ELSE 0 END, 5) + 0.0 AS score FROM b JOIN m USING (band)""")
def dispersion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cells(spark, sf_dir).count()
    return qc.dispersion_ranks(qc.feature_moments(rna(spark, sf_dir), n), 5).select("feature_id", (F.round("score", 5) + 0.0).alias("score"))


@query(f"""WITH {CELLS}, s AS (SELECT branch, count(*) AS n FROM cells GROUP BY 1) SELECT branch, n, n >= 100 AS modelled, CAST(greatest(5, least(n // 10, 50)) AS INTEGER) AS n_bins, CAST(greatest(5, least(50, CAST(floor(2.0 * n / 10) AS BIGINT))) AS INTEGER) AS n_smooth_bins FROM s""")
def cohort_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort counts, the size rule and the two bin count rules."""
    n = F.col("n")
    sizes = cells(spark, sf_dir).groupBy("branch").agg(F.count("*").alias("n"))
    return sizes.select("branch", "n", (n >= 100).alias("modelled"), binning.bin_count(n, 10, 50).alias("n_bins"), binning.smooth_bin_count(n, 10, 50, 2.0).alias("n_smooth_bins"))


@query(f"""WITH {RNA}, {CELLS}, t AS (SELECT cell_id, sum(value) AS t FROM rna GROUP BY 1), v AS (SELECT r.cell_id, feature_id, round(ln(1 + 10000 * value / t), 6) AS v, branch FROM rna r JOIN t USING (cell_id) JOIN cells USING (cell_id)),
g AS (SELECT f.feature_id, c.cell_id, c.branch FROM (SELECT DISTINCT feature_id FROM v) f CROSS JOIN cells c), d AS (SELECT g.feature_id, g.cell_id, g.branch, coalesce(v.v, 0) AS v FROM g LEFT JOIN v ON v.cell_id = g.cell_id AND v.feature_id = g.feature_id),
r AS (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY v) + (count(*) OVER (PARTITION BY feature_id, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY feature_id, v) AS tie FROM d),
f AS (SELECT feature_id, sum(CAST(tie AS DOUBLE) * tie - 1) AS ties, count(*) AS n, count(*) FILTER (v > 0) AS pos FROM r GROUP BY 1),
c AS (SELECT feature_id, branch, sum(rk) AS rs, count(*) AS n1, count(*) FILTER (v > 0) AS p1 FROM r GROUP BY 1, 2)
SELECT branch AS cluster, feature_id, round((rs - n1 * (n + 1) / 2.0) / sqrt(CAST(n1 AS DOUBLE) * (n - n1) / 12 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))), 4) + 0.0 AS score, round(p1 / n1, 6) AS pct_in, round((pos - p1) / (n - n1), 6) AS pct_out FROM c JOIN f USING (feature_id)""")
def cluster_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-sum markers of each branch with implicit zeros and ties."""
    logged = qc.log_cp10k(rna(spark, sf_dir)).withColumn("value", F.round("value", 6))
    clusters = cells(spark, sf_dir).select("cell_id", F.col("branch").alias("cluster"))
    ranked = qc.rank_markers(logged, clusters, 10_000)
    return ranked.select("cluster", "feature_id", (F.round("score", 4) + 0.0).alias("score"), F.round("pct_in", 6).alias("pct_in"), F.round("pct_out", 6).alias("pct_out"))


@query(f"""WITH {CELLS}, {bins_sql(12)} SELECT branch, bin, count(*) AS n_cells, min(pseudotime) AS first_time, max(pseudotime) AS last_time FROM binned GROUP BY 1, 2""")
def equal_frequency_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = binning.equal_frequency_bins(cells(spark, sf_dir), 12)
    return binned.groupBy("branch", "bin").agg(F.count("*").alias("n_cells"), F.min("pseudotime").alias("first_time"), F.max("pseudotime").alias("last_time"))


@query(f"""WITH {CELLS}, {RNA}, {bins_sql(12)}, {means_sql("rna", "r")} SELECT branch, bin, feature_id, round(value, 6) AS value FROM r""")
def hard_bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = binning.hard_bin_means(rna(spark, sf_dir), written(binning.equal_frequency_bins(cells(spark, sf_dir), 12), "bins"))
    return means.select("branch", "bin", "feature_id", F.round("value", 6).alias("value"))


KERNEL = """spans AS (SELECT branch, min(pseudotime) AS lo, max(pseudotime) AS hi, count(*) AS n FROM cells GROUP BY 1),
centres AS (SELECT branch, CAST(b AS INTEGER) AS bin, lo + (hi - lo) / 10 * (b + 0.5) AS centre, (hi - lo) / 10 * greatest(1.0, 15.0 / (n / 10)) AS width FROM spans, range(10) t(b)),
w AS (SELECT c.branch, k.bin, c.cell_id, exp(-0.5 * pow((centre - pseudotime) / width, 2)) AS w, pseudotime FROM cells c JOIN centres k ON c.branch = k.branch)"""


@query(f"""WITH {CELLS}, {RNA}, {KERNEL}, t AS (SELECT branch, bin, sum(w) AS t FROM w GROUP BY 1, 2)
SELECT w.branch, w.bin, feature_id, round(sum(w * value) / (t + 1e-10), 6) AS value FROM w JOIN rna USING (cell_id) JOIN t ON t.branch = w.branch AND t.bin = w.bin GROUP BY 1, 2, 3, t""")
def gaussian_bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    means = binning.kernel_means(rna(spark, sf_dir), binning.kernel_weights(c, binning.kernel_centres(c, 10, 15), -1.0))
    return means.select("branch", "bin", "feature_id", F.round("value", 6).alias("value"))


@query(f"""WITH {CELLS}, {RNA}, {KERNEL}, k AS (SELECT * FROM w WHERE w > 0.6), s AS (SELECT k.branch, k.bin, feature_id, sum(w * value) AS s FROM k JOIN rna USING (cell_id) GROUP BY 1, 2, 3),
d AS (SELECT c.branch, c.bin, coalesce(sum(w), 0) AS t, count(w) AS support FROM centres c LEFT JOIN k ON k.branch = c.branch AND k.bin = c.bin GROUP BY 1, 2), f AS (SELECT DISTINCT feature_id FROM rna)
SELECT d.branch, d.bin, f.feature_id, support, CASE WHEN t > 0 AND support >= (SELECT count(*) // 20 FROM cells) THEN round(coalesce(s, 0) / (t + 1e-10), 6) END AS value
FROM d CROSS JOIN f LEFT JOIN s ON s.branch = d.branch AND s.bin = d.bin AND s.feature_id = f.feature_id""")
def planned_bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means under a kernel cut at 0.6; bins that less than a twentieth of all cells support are unknown."""
    c = cells(spark, sf_dir)
    centres = binning.kernel_centres(c, 10, 15)
    w = written(binning.kernel_weights(c, centres, 0.6), "weights")
    bins = planned.planned_bins(w, centres, c.count() // 20)
    means = planned.planned_means(rna(spark, sf_dir), w, bins)
    return means.join(bins.select("branch", "bin", "support"), ["branch", "bin"]).select("branch", "bin", "feature_id", "support", F.round("value", 6).alias("value"))


@query(f"""WITH {CELLS}, {KERNEL} SELECT branch, bin, round(pow(sum(w), 2) / sum(w * w), 5) AS ess, count(*) FILTER (w > 0.001) AS support, round(sum(w * pseudotime) / sum(w), 5) AS time_mean FROM w GROUP BY 1, 2""")
def kernel_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    d = binning.bin_diagnostics(binning.kernel_weights(c, binning.kernel_centres(c, 10, 15), -1.0), c)
    return d.select("branch", "bin", F.round("ess", 5).alias("ess"), "support", F.round("time_mean", 5).alias("time_mean"))


@query(f"""WITH {CELLS}, {KERNEL}, n AS (SELECT branch, bin, sqrt(sum(w * w)) AS n FROM w GROUP BY 1, 2)
SELECT a.branch, a.bin, round(sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)), 6) AS overlap FROM w a JOIN w b ON a.cell_id = b.cell_id AND b.bin = a.bin + 1 JOIN n x ON x.branch = a.branch AND x.bin = a.bin JOIN n y ON y.branch = b.branch AND y.bin = b.bin GROUP BY 1, 2""")
def kernel_neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return binning.neighbour_overlap(binning.kernel_weights(c, binning.kernel_centres(c, 10, 15), -1.0)).select("branch", "bin", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {CELLS}, {KERNEL}, m AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0]) AS multiplier),
e AS (SELECT k.branch, k.bin, k.width, multiplier, pow(sum(exp(-0.5 * pow((centre - pseudotime) / (width * multiplier), 2))), 2) / sum(exp(-pow((centre - pseudotime) / (width * multiplier), 2))) AS ess FROM centres k JOIN cells c ON c.branch = k.branch CROSS JOIN m GROUP BY 1, 2, 3, 4)
SELECT branch, bin, CAST(coalesce(min(multiplier) FILTER (ess >= 300), max(multiplier)) AS DOUBLE) AS multiplier FROM e GROUP BY 1, 2""")
def ess_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return binning.ess_bandwidth(c, binning.kernel_centres(c, 10, 15), [0.05, 0.1, 0.25, 0.5, 1.0], 300).select("branch", "bin", "multiplier")


@query(f"""WITH {CELLS}, old AS (SELECT * FROM cells WHERE cell_id % 2 = 0), {bins_sql(8).replace("FROM cells GROUP", "FROM old GROUP")}
SELECT c.branch, CASE WHEN pseudotime BETWEEN e[1] AND e[len(e)] THEN bin END AS bin, count(*) AS n FROM binned c JOIN edges USING (branch) GROUP BY 1, 2""")
def frozen_bin_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells under edges frozen on every other cell; no extrapolation."""
    c = cells(spark, sf_dir)
    return binning.frozen_membership(c, binning.equal_frequency_edges(c.where("cell_id % 2 = 0"), 8)).groupBy("branch", "bin").agg(F.count("*").alias("n"))


@query(f"""WITH {CELLS}, cuts(branch, cut) AS (VALUES (0, 2500.0), (0, 3500.0), (1, 3000.0)) SELECT c.branch, CAST((SELECT count(*) FROM cuts k WHERE k.branch = c.branch AND cut <= pseudotime) AS INTEGER) AS region, count(*) AS n FROM cells c GROUP BY 1, 2""")
def boundary_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = spark.createDataFrame([(0, 2500.0), (0, 3500.0), (1, 3000.0)], "branch long, cut double")
    return binning.boundary_regions(cells(spark, sf_dir), cuts).groupBy("branch", "region").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT o_orderkey AS cell_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS pseudotime, CASE WHEN o_custkey % 100 < 2 THEN 100 + o_custkey % 100 ELSE o_custkey % 3 END AS branch FROM orders),
m AS (SELECT branch, count(*) AS n, quantile_cont(pseudotime, 0.5) AS mid FROM c GROUP BY 1), s AS (SELECT m.branch, arg_min(l.branch, abs(m.mid - l.mid)) AS dest FROM m, m l WHERE m.branch >= 100 AND l.branch < 100 GROUP BY 1)
SELECT coalesce(dest, branch) AS branch, count(*) AS n FROM c LEFT JOIN s USING (branch) GROUP BY 1""")
def merge_small_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey")), "cell_id")
    c = c.withColumn("branch", F.when(F.col("o_custkey") % 100 < 2, 100 + F.col("o_custkey") % 100).otherwise(F.col("branch")))
    limit = c.count() // 10
    return binning.merge_small_branches(c, limit).groupBy("branch").agg(F.count("*").alias("n"))


def bin_state(spark: SparkSession, sf_dir: str, n_bins: int) -> tuple[DataFrame, DataFrame]:
    """Hard bin means of genes and peaks on shared bins, which are made once."""
    binned = written(binning.equal_frequency_bins(cells(spark, sf_dir), n_bins), "bins")
    return binning.hard_bin_means(rna(spark, sf_dir), binned), binning.hard_bin_means(atac(spark, sf_dir), binned)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, peak) pairs that lie near each other."""
    return regions.band_pairs(peak_loci(spark, sf_dir), gene_loci(spark, sf_dir), BAND).select("gene", "peak")


def lagged_rows(spark: SparkSession, sf_dir: str, n_bins: int) -> DataFrame:
    """(gene, peak, branch, bin, y, l, x) of candidate pairs: y and l from the gene, x from the peak a bin before.

    Candidates meet the gene's series by gene, and then the peak's by peak and bin.
    """
    genes, peaks = bin_state(spark, sf_dir, n_bins)
    y = binning.lag_pairs(genes, 1, ["feature_id", "branch"]).select(F.col("feature_id").alias("gene"), "branch", "bin", F.col("value").alias("y"), F.col("lagged").alias("l"))
    x = peaks.select(F.col("feature_id").alias("peak"), "branch", (F.col("bin") + 1).alias("bin"), F.col("value").alias("x"))
    return candidates(spark, sf_dir).join(y, "gene").join(x, ["peak", "branch", "bin"])


LAGGED = f"""{CELLS}, {RNA}, {ATAC}, {bins_sql(16)}, {means_sql("rna", "r")}, {means_sql("atac", "a")}, {LOCI},
rows_ AS (SELECT y.feature_id AS gene, x.feature_id AS peak, y.value AS y, l.value AS l, x.value AS x FROM candidates c JOIN r y ON y.feature_id = c.gene JOIN r l ON l.feature_id = y.feature_id AND l.branch = y.branch AND l.bin = y.bin - 1 JOIN a x ON x.feature_id = c.peak AND x.branch = y.branch AND x.bin = y.bin - 1)"""
GRANGER = f"""{LAGGED}, m AS (SELECT gene, peak, count(*) AS n, var_pop(y) AS vy, var_pop(l) AS vl, var_pop(x) AS vx, covar_pop(y, l) / sqrt(var_pop(y) * var_pop(l)) AS ryl, covar_pop(y, x) / sqrt(var_pop(y) * var_pop(x)) AS ryx, covar_pop(l, x) / sqrt(var_pop(l) * var_pop(x)) AS rlx FROM rows_ GROUP BY 1, 2),
g AS (SELECT gene, peak, n, pow(ryx - ryl * rlx, 2) / ((1 - ryl * ryl) * (1 - rlx * rlx)) AS delta_r2, sqrt(vy / vx) * (ryx - ryl * rlx) / (1 - rlx * rlx) AS coef, ryx AS pearson_r FROM m WHERE vy >= 1e-6 AND vx >= 1e-6 AND vl > 1e-15 AND n > 3),
p AS (SELECT *, delta_r2 / (1 - delta_r2) * (n - 3) AS f FROM g), q AS (SELECT *, {tail_sql("f", "(n - 3)")} AS p_value FROM p)"""


@query(f"""WITH {GRANGER}, k AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS r FROM q),
b AS (SELECT *, least(1, min(p_value * m / r) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM k), s AS (SELECT *, pow((50.0 - 3) / greatest(n - 3, 1), 2) AS c FROM b),
z AS (SELECT *, 0.4 * greatest(0, least(1, 1 - p_adj / (0.1 / c))) + 0.6 * greatest(0, least(2, delta_r2 / greatest(0.02 * c, 1e-10))) / 2 AS composite FROM s)
SELECT gene, peak, n, round(f, 5) AS f_stat, round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj, round(delta_r2, 6) AS delta_r2, round(coef, 6) + 0.0 AS coef, round(pearson_r, 6) + 0.0 AS pearson_r, round(composite, 6) AS composite, composite >= 0.3 AS is_causal, p_adj < 0.1 AND delta_r2 > 0.02 AS is_hard FROM z""")
def granger_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged regressions of genes on their candidate peaks with adjusted p-values and composite scores."""
    s = screening.score_edges(screening.granger(lagged_rows(spark, sf_dir, 16), ["gene", "peak"]))
    return s.select("gene", "peak", "n", F.round("f_stat", 5).alias("f_stat"), *(F.round(c, 6).alias(c) for c in ("p_value", "p_adj", "delta_r2")), *((F.round(c, 6) + 0.0).alias(c) for c in ("coef", "pearson_r")), F.round("composite", 6).alias("composite"), "is_causal", "is_hard")


@query(f"""WITH {LAGGED}, m AS (SELECT gene, peak, count(*) AS n, pow(covar_pop(y, x), 2) / (var_pop(y) * var_pop(x)) AS d FROM rows_ GROUP BY 1, 2 HAVING var_pop(y) >= 1e-6 AND var_pop(x) >= 1e-6), f AS (SELECT *, d / (1 - d) * (n - 2) AS f FROM m)
SELECT gene, peak, n, round(d, 6) AS delta_r2, round({tail_sql("f", "(n - 2)")}, 6) AS p_value FROM f""")
def granger_contemporaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = screening.contemporaneous(lagged_rows(spark, sf_dir, 16), ["gene", "peak"])
    return c.select("gene", "peak", "n", F.round("delta_r2", 6).alias("delta_r2"), F.round("p_value", 6).alias("p_value"))


def factor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tf, peak_id) pairs that share a line item."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % GENES).alias("tf"), (F.col("l_suppkey") % PEAKS).alias("peak_id")).distinct()


ROUTES = f"""{CELLS}, {RNA}, {ATAC}, {bins_sql(16)}, {means_sql("rna", "r")}, {means_sql("atac", "a")},
bb AS (SELECT DISTINCT branch, bin FROM a), near AS (SELECT * FROM (SELECT b.branch, b.bin, k, t.bin AS t, t.bin - k AS s, row_number() OVER (PARTITION BY b.branch, b.bin, k ORDER BY abs(t.bin - b.bin), t.bin) AS rn FROM bb b CROSS JOIN range(4) g(k) JOIN bb t ON t.branch = b.branch AND t.bin >= k WHERE k <= b.bin) WHERE rn <= 12),
e AS (SELECT DISTINCT l_partkey % 40 AS tf, l_suppkey % 60 AS peak_id FROM lineitem),
m AS (SELECT tf, peak_id, n.branch, n.bin, k, count(*) AS n, var_pop(x.value) AS vx, var_pop(y.value) AS vy, covar_pop(x.value, y.value) AS c FROM e JOIN r x ON x.feature_id = tf JOIN near n ON n.branch = x.branch AND n.s = x.bin JOIN a y ON y.feature_id = peak_id AND y.branch = n.branch AND y.bin = n.t GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT *, n >= 3 AND vx >= 1e-12 AND vy > 1e-15 AS ok, CASE WHEN n >= 3 AND vx >= 1e-12 AND vy > 1e-15 THEN greatest(-1, least(1, c / sqrt(vx * vy))) END AS r_ FROM m),
u AS (SELECT *, CASE WHEN ok THEN CASE WHEN 1 - r_ * r_ <= 1e-15 THEN 0 ELSE {tail_sql("(r_ * r_ * (n - 2) / (1 - r_ * r_))", "(n - 2)")} END END AS p FROM t),
h AS (SELECT *, coalesce(p <= 0.05, false) AS hit FROM u), l AS (SELECT tf, peak_id, branch, bin, min(k) FILTER (hit) AS lag FROM h GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {ROUTES} SELECT h.tf, h.peak_id, h.branch, h.bin, CASE WHEN lag IS NULL THEN 'no_supported_lag' ELSE 'supported' END AS status, CAST(lag AS INTEGER) AS selected_lag, CAST(CASE WHEN lag IS NULL THEN -1 ELSE h.bin - lag END AS INTEGER) AS source_bin,
round(max(c / vx) FILTER (k = lag), 5) + 0.0 AS weight, round(max(p) FILTER (k = lag), 5) AS p_value, count(*) FILTER (k <= coalesce(lag, 999)) AS n_lag_attempts, count(p) FILTER (k <= coalesce(lag, 999)) AS n_stat_tests
FROM h JOIN l ON l.tf = h.tf AND l.peak_id = h.peak_id AND l.branch = h.branch AND l.bin = h.bin GROUP BY 1, 2, 3, 4, lag""")
def local_lag_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supported lag of each factor, peak and bin."""
    genes, peaks = bin_state(spark, sf_dir, 16)
    routes = screening.local_lag_routes(screening.local_lag_tests(genes, peaks, factor_edges(spark, sf_dir), 3), 0.05)
    return routes.select("tf", "peak_id", "branch", "bin", "status", "selected_lag", "source_bin", (F.round("weight", 5) + 0.0).alias("weight"), F.round("p_value", 5).alias("p_value"), "n_lag_attempts", "n_stat_tests")


@query(f"""WITH {ROUTES}, b AS (SELECT h.* FROM h JOIN l ON l.tf = h.tf AND l.peak_id = h.peak_id AND l.branch = h.branch AND l.bin = h.bin AND h.k = l.lag)
SELECT tf, peak_id, count(*) AS n_bins, round(avg(c / vx), 5) + 0.0 AS weight, round(max(p), 5) AS p_value, round(avg(abs(c / vx) * sqrt(vx)), 5) AS contribution, CAST(min(k) AS INTEGER) AS min_lag, CAST(max(k) AS INTEGER) AS max_lag FROM b GROUP BY 1, 2""")
def local_lag_edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes, peaks = bin_state(spark, sf_dir, 16)
    s = screening.edge_summary(screening.local_lag_routes(screening.local_lag_tests(genes, peaks, factor_edges(spark, sf_dir), 3), 0.05))
    return s.select("tf", "peak_id", "n_bins", (F.round("weight", 5) + 0.0).alias("weight"), F.round("p_value", 5).alias("p_value"), F.round("contribution", 5).alias("contribution"), "min_lag", "max_lag")


@query(f"""WITH {CELLS}, {RNA}, {bins_sql(16)}, {means_sql("rna", "r")}, d AS (SELECT branch, feature_id, abs(value - lag(value) OVER (PARTITION BY branch, feature_id ORDER BY bin)) AS ch FROM r), s AS (SELECT branch, feature_id, coalesce(avg(ch), 0) AS s FROM d GROUP BY 1, 2)
SELECT branch, feature_id, round(s / sum(s) OVER (PARTITION BY branch), 6) AS alpha, 'ok' AS status FROM s""")
def frozen_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of inputs by their mean adjacent change in control data."""
    genes, _ = bin_state(spark, sf_dir, 16)
    changes = screening.adjacent_changes(genes.withColumn("supported", F.lit(True)), ["branch", "feature_id"])
    return screening.frozen_weights(changes, ["branch"], ["feature_id"]).select("branch", "feature_id", F.round("alpha", 6).alias("alpha"), "status")
