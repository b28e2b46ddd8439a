"""Windows and sessions of events, in the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.frames import read
from strandline.plans.registry import query
from strandline.streaming import bins


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = bins.windowed_means(read(spark, sf_dir, "events"))
    return w.select("start", "event_type", "n", F.round("value", 6).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 5) AS value FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bins.sessions(read(spark, sf_dir, "events"))
    return s.select("user_id", "start", "n", F.round("value", 5).alias("value"))
