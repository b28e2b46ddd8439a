"""Variable features by a local fit, over all parts as genes and all orders as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.variable import variable_by_loess
from strandline.plans.frames import read
from strandline.plans.registry import query


@query("""WITH entries AS (SELECT l_orderkey AS cell_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM orders),
m AS (SELECT feature_id, sum(value) / n AS mean, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS variance FROM entries, n GROUP BY feature_id, n),
p AS (SELECT feature_id, log10(mean) AS x, log10(variance) AS y FROM m WHERE variance > 1e-12 * mean * mean), q AS (SELECT greatest(1, CAST(floor(0.3 * count(*) + 1e-5) AS INTEGER)) AS q FROM p),
h AS (SELECT a.feature_id, a.x, list_sort(list(abs(b.x - a.x)))[any_value(q)] AS h FROM p a, p b, q GROUP BY 1, 2),
w AS (SELECT h.feature_id, (b.x - h.x) / h AS z, y, pow(1 - pow(abs(b.x - h.x) / h, 3), 3) AS w FROM h JOIN p b ON abs(b.x - h.x) < h),
s AS (SELECT feature_id, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * z * z * z) AS s3, sum(w * z * z * z * z) AS s4, sum(w * y) AS t0, sum(w * z * y) AS t1, sum(w * z * z * y) AS t2 FROM w GROUP BY 1),
f AS (SELECT feature_id, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS fitted FROM s),
c AS (SELECT e.feature_id, sum(least(value, mean + pow(10, fitted / 2) * sqrt(n))) AS s, sum(pow(least(value, mean + pow(10, fitted / 2) * sqrt(n)), 2)) AS q FROM entries e JOIN m USING (feature_id) JOIN f USING (feature_id), n GROUP BY 1)
SELECT feature_id, round(fitted, 5) AS fitted, round((n * mean * mean + q - 2 * mean * s) / ((n - 1) * pow(10, fitted)), 5) AS standardised FROM c JOIN m USING (feature_id) JOIN f USING (feature_id), n""")
def loess_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted and standardised variances of every part's quantities over orders."""
    entries = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").cast("double").alias("value"))
    got = variable_by_loess(entries, read(spark, sf_dir, "orders").count(), 2000)
    return got.select("feature_id", F.round("fitted", 5).alias("fitted"), F.round("standardised", 5).alias("standardised"))
