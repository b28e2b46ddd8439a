"""Queries of the adaptive plan: pilots, widths and boundaries of the orders' pseudotime, with their line items as states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import adaptive
from strandline.plans.frames import CELLS, cells, read
from strandline.plans.registry import query

BINS, SUB, LEAST, WIDTHS = 10, 3, 8, (0.5, 1.0, 1.5, 2.0)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells whose state has two numbers: quantity in all and mean line number of their items."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.sum("l_quantity").cast("double").alias("_q"), F.avg("l_linenumber").cast("double").alias("_l"))
    return cells(spark, sf_dir).join(line, "cell_id").select("cell_id", "branch", "pseudotime", F.array(F.col("_q") / 100, "_l").alias("vec"))


STATES = f"""{CELLS}, per_order AS (SELECT l_orderkey AS cell_id, CAST(sum(l_quantity) AS DOUBLE) / 100 AS q, CAST(avg(l_linenumber) AS DOUBLE) AS l FROM lineitem GROUP BY 1),
states AS (SELECT c.*, q, l FROM cells c JOIN per_order USING (cell_id)),
values_ AS (SELECT cell_id, branch, pseudotime, 0 AS dim, q AS y FROM states UNION ALL SELECT cell_id, branch, pseudotime, 1, l FROM states),
spans AS (SELECT branch, min(pseudotime) AS low, max(pseudotime) AS high FROM states GROUP BY 1)"""
PILOTS = f"""{STATES}, grid AS (SELECT branch, j AS pilot, (high - low) / {BINS * SUB} AS width, low, low + (j + 0.5) * ((high - low) / {BINS * SUB}) AS mid FROM spans, range({BINS * SUB}) t(j)),
own AS (SELECT v.*, least(floor((pseudotime - s.low) / ((s.high - s.low) / {BINS * SUB})), {BINS * SUB} - 1)::INTEGER AS pilot FROM values_ v JOIN spans s USING (branch)),
placed AS (SELECT o.*, pseudotime - mid AS x FROM own o JOIN grid g USING (branch, pilot)),
lines AS (SELECT branch, pilot, dim, count(*) AS n, avg(x) AS mx, var_pop(x) * count(*) AS ss, avg(y) AS my, covar_pop(x, y) * count(*) AS xy, var_pop(y) * count(*) AS yy FROM placed GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST} AND max(x) > min(x)),
fits AS (SELECT branch, pilot, dim, any_value(n) AS n, any_value(mx) AS mx, any_value(ss) AS ss, any_value(my - xy / ss * mx) AS mu, any_value(yy - xy * xy / ss) AS rest FROM lines GROUP BY 1, 2, 3),
noises AS (SELECT branch, pilot, any_value(n) AS n, sum(rest) / (any_value(n) - 2) AS noise, sum(rest) / (any_value(n) - 2) * (1 / any_value(n) + any_value(mx * mx / ss)) AS variance FROM fits GROUP BY 1, 2)"""


@query(f"""WITH {PILOTS} SELECT branch, pilot, n, round(noise, 6) AS noise, round(variance, 6) AS variance, round(max(mu) FILTER (dim = 0), 6) AS mu_0, round(max(mu) FILTER (dim = 1), 6) AS mu_1 FROM noises JOIN fits USING (branch, pilot, n) GROUP BY ALL""")
def state_pilots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, noise and middle values of the pilots with enough cells."""
    made = states(spark, sf_dir)
    pilots, _ = adaptive.state_pilots(made, adaptive.equal_time_centres(made, BINS), SUB, LEAST)
    r = [F.round(F.col(c), 6).alias(c) for c in ("noise", "variance")]
    return pilots.where("rank = 2").select("branch", "pilot", "n", *r, *[F.round(F.col("mu")[k], 6).alias(f"mu_{k}") for k in (0, 1)])


@query(f"""WITH {PILOTS}, bins AS (SELECT branch, CAST(i AS INTEGER) AS bin, (high - low) / {BINS} AS spacing, low + (high - low) / {BINS} / 2 + i * (((high - (high - low) / {BINS} / 2) - (low + (high - low) / {BINS} / 2)) / {BINS - 1}) AS centre FROM spans, range({BINS}) t(i)),
offered AS (SELECT b.*, m AS multiplier FROM bins b, (SELECT unnest({list(WIDTHS)}::DOUBLE[]) AS m)),
w AS (SELECT o.branch, o.bin, o.multiplier, g.pilot, exp(-0.5 * pow((g.mid - o.centre) / (o.spacing * o.multiplier), 2)) AS w FROM offered o JOIN grid g USING (branch)),
mass AS (SELECT w.branch, bin, multiplier, sum(w) AS total, coalesce(sum(w) FILTER (n.pilot IS NOT NULL), 0) AS mass, count(n.pilot) AS pilots FROM w LEFT JOIN noises n ON n.branch = w.branch AND n.pilot = w.pilot GROUP BY 1, 2, 3),
p AS (SELECT w.branch, w.bin, w.multiplier, w.pilot, w.w / m.mass AS p FROM w JOIN mass m USING (branch, bin, multiplier)),
spread AS (SELECT branch, bin, multiplier, sum(d) AS d FROM (SELECT branch, bin, multiplier, dim, sum(p * mu * mu) - pow(sum(p * mu), 2) AS d FROM p JOIN fits USING (branch, pilot) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
levels AS (SELECT branch, bin, multiplier, sum(p * (1 - p) * variance) AS correction, sum(p * noise) AS noise FROM p JOIN noises USING (branch, pilot) GROUP BY 1, 2, 3)
SELECT branch, bin, multiplier, pilots, round(mass / total, 6) AS coverage, round(greatest(d - correction, 0), 6) AS distortion, round(noise, 6) AS noise FROM mass JOIN spread USING (branch, bin, multiplier) JOIN levels USING (branch, bin, multiplier) WHERE pilots >= 2""")
def state_distortions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each width of each bin distorts, beside its noise and the pilots in its sight."""
    made = states(spark, sf_dir)
    centres = adaptive.equal_time_centres(made, BINS)
    pilots, _ = adaptive.state_pilots(made, centres, SUB, LEAST)
    got = adaptive.state_scores(pilots, centres, list(WIDTHS)).where("evidence")
    return got.select("branch", "bin", "multiplier", "pilots", *[F.round(c, 6).alias(c) for c in ("coverage", "distortion", "noise")])


@query()
def state_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest width of each bin that the bootstrap of 20 replicates accepts."""
    made = states(spark, sf_dir)
    centres = adaptive.equal_time_centres(made, BINS)
    pilots, _ = adaptive.state_pilots(made, centres, SUB, LEAST, 20)
    return adaptive.state_bandwidths(adaptive.state_scores(pilots, centres, list(WIDTHS)), centres)


def half_sql(what: str, source: str, groups: str, limit: str, half: str) -> str:
    d = f"CAST('0x' || substr(md5('0|{what}|' || split || '|' || branch || '|' || left_ || '|' || cell_id), 1, 8) AS BIGINT)"
    return f"""(SELECT *, {half} AS half FROM (SELECT *, row_number() OVER (PARTITION BY branch, left_, split{groups} ORDER BY {d}, cell_id) - 1 AS nth FROM {source}, range(20) t(split)) WHERE nth < {limit})"""


@query(f"""WITH {STATES}, e0 AS (SELECT branch, CAST(i AS INTEGER) AS bin, low + (high - low) / {BINS} / 2 + i * (((high - (high - low) / {BINS} / 2) - (low + (high - low) / {BINS} / 2)) / {BINS - 1}) AS centre FROM spans, range({BINS}) t(i)),
e AS (SELECT a.branch, a.bin AS left_, (a.centre + b.centre) / 2 AS edge FROM e0 a JOIN e0 b ON a.branch = b.branch AND b.bin = a.bin + 1),
binned AS (SELECT s.cell_id, s.branch, count(e.edge) AS bin FROM states s LEFT JOIN e ON e.branch = s.branch AND e.edge <= s.pseudotime GROUP BY 1, 2),
sided AS (SELECT b.cell_id, b.branch, e.left_, CAST(b.bin > e.left_ AS INTEGER) AS side FROM binned b JOIN e ON e.branch = b.branch AND e.left_ IN (b.bin, b.bin - 1)),
n AS (SELECT e.branch, e.left_, edge, count(*) FILTER (side = 0) AS left_count, count(*) FILTER (side = 1) AS right_count FROM e LEFT JOIN sided USING (branch, left_) GROUP BY 1, 2, 3),
used AS (SELECT s.*, greatest(1, least(left_count, right_count) // 2) AS m FROM sided s JOIN n USING (branch, left_) WHERE least(left_count, right_count) >= 12),
vals AS (SELECT u.cell_id, u.branch, u.left_, u.side, dim, y, y - median(y) OVER (PARTITION BY u.branch, u.left_, u.side, dim) AS r FROM used u JOIN values_ v USING (cell_id)),
halves AS (SELECT o.branch, o.left_, 'observed' AS what, split, half, dim, median(y) AS median FROM {half_sql("observed", "used", ", side", "m", "side")} o JOIN vals v ON v.cell_id = o.cell_id AND v.branch = o.branch AND v.left_ = o.left_ GROUP BY ALL
 UNION ALL SELECT o.branch, o.left_, 'noise', split, half, dim, median(r) FROM {half_sql("noise", "used", "", "2 * m", "CAST(nth >= m AS INTEGER)")} o JOIN vals v ON v.cell_id = o.cell_id AND v.branch = o.branch AND v.left_ = o.left_ GROUP BY ALL),
apart AS (SELECT branch, left_, what, split, sqrt(sum(d * d)) AS d FROM (SELECT branch, left_, what, split, dim, sum(CASE WHEN half = 0 THEN median ELSE -median END) AS d FROM halves GROUP BY ALL) GROUP BY ALL),
level AS (SELECT branch, left_, median(d) AS level, median(d) + 3 * mad(d) AS threshold FROM apart WHERE what = 'noise' GROUP BY 1, 2),
share AS (SELECT branch, left_, any_value(threshold) AS threshold, avg(CASE WHEN d > threshold THEN 1.0 ELSE 0 END) AS stability FROM apart JOIN level USING (branch, left_) WHERE what = 'observed' GROUP BY 1, 2)
SELECT n.branch, n.left_ AS "left", round(edge, 6) AS edge, left_count, right_count, round(stability, 6) AS stability, round(threshold, 6) AS threshold, CASE WHEN stability IS NULL THEN 'uncertain_insufficient_support' WHEN stability >= 0.8 THEN 'stable' ELSE 'uncertain_noise' END AS status FROM n LEFT JOIN share s ON s.branch = n.branch AND s.left_ = n.left_""")
def stable_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between bins, and whether the states of the cells jump there."""
    made = states(spark, sf_dir)
    got = adaptive.boundaries(made, adaptive.equal_time_centres(made, BINS))
    r = {c: F.round(c, 6) for c in ("edge", "stability", "threshold")}
    return got.withColumns(r).select("branch", "left", "edge", "left_count", "right_count", "stability", "threshold", "status")
