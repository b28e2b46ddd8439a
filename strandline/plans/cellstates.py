"""Root, potency, kernel size and counterfactual cell queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import binning, effects, qc
from strandline.plans.cohort import KERNEL
from strandline.plans.frames import ATAC, CELLS, RNA, atac, bins_sql, cells, means_sql, rna
from strandline.plans.registry import query


@query(f"""WITH {CELLS}, {KERNEL}, g AS (SELECT a.branch, a.bin AS i, b.bin AS j, sum(a.w * b.w) AS g FROM w a JOIN w b ON a.branch = b.branch AND a.cell_id = b.cell_id GROUP BY 1, 2, 3) SELECT branch, round(pow(sum(g) FILTER (i = j), 2) / sum(g * g), 6) AS effective_rows FROM g GROUP BY 1""")
def kernel_effective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    r = binning.effective_rows(binning.kernel_weights(c, binning.kernel_centres(c, 10, 15), -1.0))
    return r.select("branch", F.round("effective_rows", 6).alias("effective_rows"))


@query(f"""WITH {CELLS}, {RNA}, s AS (SELECT cell_id, branch, value AS score FROM rna JOIN cells USING (cell_id) WHERE feature_id = 7 AND branch < 2), t AS (SELECT cell_id, branch, sum(value) AS total FROM rna JOIN cells USING (cell_id) GROUP BY 1, 2),
m AS (SELECT branch, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY score DESC, cell_id) AS k FROM s WHERE score > 0) WHERE k = 1), l AS (SELECT branch, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY total, cell_id) AS k FROM t) WHERE k = 1)
SELECT l.branch, coalesce(m.cell_id, l.cell_id) AS root, CASE WHEN m.cell_id IS NULL THEN 'least_total' ELSE 'marker' END AS rule FROM l LEFT JOIN m USING (branch)""")
def root_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots by a marker where the branch has it, else by the least total."""
    e = rna(spark, sf_dir).join(cells(spark, sf_dir), "cell_id")
    scores = e.where("feature_id = 7 and branch < 2").select("cell_id", "branch", F.col("value").alias("score"))
    return binning.root_cells(scores, e.groupBy("cell_id", "branch").agg(F.sum("value").alias("total")))


@query(f"""WITH {RNA}, t AS (SELECT cell_id, sum(value) AS t FROM rna GROUP BY 1), v AS (SELECT r.cell_id, feature_id, ln(1 + 10000 * value / t) AS v FROM rna r JOIN t USING (cell_id)), g AS (SELECT cell_id, CAST(count(*) FILTER (v > 0) AS DOUBLE) AS g FROM v GROUP BY 1),
w AS (SELECT count(*) AS n, sum(g) AS sg, sum(g * g) AS sgg FROM g), s AS (SELECT feature_id, sum(v) AS sx, sum(v * v) AS sxx, sum(v * g) AS sxg FROM v JOIN g USING (cell_id) GROUP BY 1), r AS (SELECT feature_id, (n * sxg - sx * sg) / sqrt((n * sxx - sx * sx) * (n * sgg - sg * sg)) AS r FROM s, w ORDER BY round(r, 9) DESC, feature_id LIMIT 10)
SELECT g.cell_id, round(coalesce(sum(v.v) / 10, 0), 6) AS potency FROM g LEFT JOIN v ON v.cell_id = g.cell_id AND v.feature_id IN (SELECT feature_id FROM r) GROUP BY 1""")
def cell_potency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = binning.potency(qc.log_cp10k(rna(spark, sf_dir)), 10)
    return p.select("cell_id", F.round("potency", 6).alias("potency"))


@query(f"""WITH {ATAC} SELECT feature_id, round(avg(CASE WHEN feature_id = 3 THEN least(greatest(least(value / 10, 1) * 0.25, 0), 1) ELSE least(value / 10, 1) END), 6) AS relative, round(avg(CASE WHEN feature_id = 3 THEN least(greatest(least(value / 10, 1) - 0.4, 0), 1) ELSE least(value / 10, 1) END), 6) AS absolute FROM atac GROUP BY 1""")
def peak_knock_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One peak lowered by three quarters, and by 0.4."""
    a = atac(spark, sf_dir).withColumn("value", F.least(F.col("value") / 10, F.lit(1.0)))
    both = effects.peak_knock_out(a, 3, 0.75).withColumnRenamed("value", "r").join(effects.peak_knock_out(a, 3, 0.4, relative=False).withColumnRenamed("value", "s"), ["cell_id", "feature_id"])
    return both.groupBy("feature_id").agg(F.round(F.avg("r"), 6).alias("relative"), F.round(F.avg("s"), 6).alias("absolute"))


@query(f"""WITH {CELLS}, {RNA}, {bins_sql(8)}, {means_sql("rna", "r")} SELECT feature_id, round(sum(x.value + CASE WHEN feature_id < 5 THEN 0.5 * r.value ELSE 0 END), 4) AS total FROM rna x JOIN binned b USING (cell_id) JOIN r USING (branch, bin, feature_id) GROUP BY 1""")
def counterfactual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells moved by a rise of five genes in their bins."""
    binned = binning.equal_frequency_bins(cells(spark, sf_dir), 8)
    control = binning.hard_bin_means(rna(spark, sf_dir), binned)
    after = control.withColumn("value", F.when(F.col("feature_id") < 5, 1.5 * F.col("value")).otherwise(F.col("value")))
    moved = effects.counterfactual_cells(rna(spark, sf_dir), binned.select("cell_id", "branch", "bin", F.lit(1.0).alias("w")), control, after)
    return moved.groupBy("feature_id").agg(F.round(F.sum("value"), 4).alias("total"))
