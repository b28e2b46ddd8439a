"""Variable features by a local fit of variance to mean, on raw counts.

The logarithm of the variance is fitted to that of the mean by local quadratic lines with tricube weights. Features are numbered along the mean, and dealt to
blocks of neighbours; what windows hold whole counts by its power sums, so the work grows with the features and not with their square. A second pass over the entries
clips what lies too far above a feature's mean and gives its variance in units of the fitted one.
"""

from __future__ import annotations

from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import counts_below
from strandline.storage import written


def local_value(x: np.ndarray, y: np.ndarray, at: float, window: int) -> float:
    """The value at `at` of the quadratic through (x, y), rising in x, weighted by tricubes up to the window-th smallest distance."""
    far = np.abs(x - at)
    h = np.partition(far, min(window, len(x)) - 1)[min(window, len(x)) - 1]
    near = far < h if h > 0 else far == 0
    z = (x[near] - at) / (h or 1.0)
    root = (1 - np.abs(z) ** 3) ** 1.5
    columns = np.stack([np.ones(len(z)), z, z * z], axis=1)
    return float(np.linalg.lstsq(columns * root[:, None], y[near] * root, rcond=None)[0][0]) if near.any() else float(y[np.argmin(far)])


#: Powers of x, and of x beside y, that tricube weights (degree 9) times a quadratic's normal equations ask for.
POWERS, Y_POWERS = 14, 12
BINOMIAL = np.array([[comb(p, k) for k in range(POWERS)] for p in range(POWERS)], float)


def _power_sums(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of u**p, and then those of y * u**p."""
    powers = np.cumprod(np.concatenate([np.ones((1, len(u))), np.repeat(u[None], POWERS - 1, axis=0)]), axis=0)
    return np.concatenate([powers.sum(axis=1), powers[:Y_POWERS] @ y])


def _shifted(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Power sums of a + b * u, a row for each a and b, from one row for all or one for each."""
    p, k = np.indices(BINOMIAL.shape)
    turn = BINOMIAL * a[:, None, None] ** np.maximum(p - k, 0) * b[:, None, None] ** k
    of_x, of_y = np.broadcast_to(sums, (len(a), POWERS + Y_POWERS))[:, :POWERS], np.broadcast_to(sums, (len(a), POWERS + Y_POWERS))[:, POWERS:]
    return np.concatenate([np.einsum("mpk,mk->mp", turn, of_x), np.einsum("mpk,mk->mp", turn[:, :Y_POWERS, :Y_POWERS], of_y)], axis=1)


def _tricubed(z: np.ndarray, side: int) -> np.ndarray:
    """Weighted sums of z**0 to z**4, and of y * z**0 to z**2, of points on one side of 0 from their power sums."""
    own = [z[:, k] - 3 * side * z[:, k + 3] + 3 * z[:, k + 6] - side * z[:, k + 9] for k in (*range(5), *range(POWERS, POWERS + 3))]
    return np.stack(own, axis=1)


def _near(x: np.ndarray, y: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same sums point by point, for every `at` with its h; points from h on have no weight."""
    out = np.zeros((len(at), 8))
    for i in range(0, len(at), 64):
        for j in range(0, len(x), 8192):
            z = (x[None, j : j + 8192] - at[i : i + 64, None]) / h[i : i + 64, None]
            w = np.maximum(1 - np.abs(z) ** 3, 0) ** 3
            for k in range(5):
                out[i : i + 64, k] += w.sum(axis=1)
                if k < 3:
                    out[i : i + 64, 5 + k] += w @ y[j : j + 8192]
                w *= z
    return out


class Blocks(NamedTuple):
    """What the driver holds of all blocks of `size` points along x: their ends, power sums about their middles, and the sums of x where windows begin and end."""

    n: int
    window: int
    size: int
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    ends: np.ndarray

    def needs(self, b: int) -> tuple[int, int, list[int], list[int]]:
        """First blocks in which windows of block b's points begin and end, the blocks that its fits need point by point, and those of which sums will do."""
        begins = np.searchsorted(self.ends, [2 * self.low[b], 2 * self.high[b]])
        most = (self.n - self.window) // self.size
        left, right = min(max(int(begins[0]) - 1, 0), most), min(int(begins[1]), most)
        first, last = ((min(r, self.n - 1)) // self.size for r in (left * self.size + self.window - 1, (right + 1) * self.size - 1 + self.window))
        inner = [k for k in range(right + 1, first) if k != b]
        middle, wide = (self.low[b] + self.high[b]) / 2, self.high[b] - self.low[b]
        # sums are moved by less than the window's reach, or rounding would grow
        if inner and wide > max(self.high[inner[-1]] - middle, middle - self.low[inner[0]]) / 2:
            inner = []
        known = set(inner)
        return left, first, [k for k in range(left, last + 1) if k not in known] + [b] * (b not in range(left, last + 1)), inner


def _summed(size: int):
    def run(rows: pa.Table) -> pa.Table:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        middle, half = (x.min() + x.max()) / 2, (x.max() - x.min()) / 2 or 1.0
        return pa.table({"block": pa.array([rows["nth"][0].as_py() // size], pa.int64()), "low": [float(x.min())], "high": [float(x.max())], "sums": [_power_sums((x - middle) / half, y).tolist()]})

    return run


def _fit(blocks: Blocks, alike: dict[float, float]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        nth, x, y = (rows[c].to_numpy() for c in ("nth", "x", "y"))
        b = rows["for"][0].as_py()
        own = nth // blocks.size == b
        at, back = np.unique(x[own], return_inverse=True)
        left, first, _, inner = blocks.needs(b)
        # the window of the nearest begins where the point after it is as far as the point it begins with
        begin = np.searchsorted(nth, left * blocks.size)
        end = np.searchsorted(nth, nth[begin:] + blocks.window)
        paired = int((end < len(nth)).sum()) if left * blocks.size + blocks.window < blocks.n else 0
        while paired and nth[end[paired - 1]] != nth[begin + paired - 1] + blocks.window:
            paired -= 1
        start = begin + np.searchsorted(x[begin : begin + paired] + x[end[:paired]], 2 * at)
        stop = np.searchsorted(nth, nth[start] + blocks.window - 1)
        h = np.maximum(at - x[start], x[stop] - at)
        fitted = np.array([alike.get(v, np.nan) for v in at.tolist()])
        wide = np.flatnonzero(h > 0)
        if len(wide):
            t, reach = at[wide], h[wide]
            sums = _near(x, y, t, reach)
            if inner:
                middle = (blocks.low[b] + blocks.high[b]) / 2
                scale = max(blocks.high[inner[-1]] - middle, middle - blocks.low[inner[0]])
                for side, part in ((-1, [k for k in inner if k < b]), (1, [k for k in inner if k > b])):
                    if part:
                        low, high = blocks.low[part], blocks.high[part]
                        half = np.where(high > low, (high - low) / 2, 1.0)
                        all_of = _shifted(blocks.sums[part], ((low + high) / 2 - middle) / scale, half / scale).sum(axis=0)
                        sums += _tricubed(_shifted(all_of, (middle - t) / reach, scale / reach), side)
            normal = sums[:, [[0, 1, 2], [1, 2, 3], [2, 3, 4]]]
            fitted[wide] = np.einsum("mk,mk->m", np.linalg.pinv(normal, rcond=1e-12, hermitian=True)[:, 0], sums[:, 5:])
            if not inner:
                low = np.linalg.eigvalsh(normal)
                for i in np.flatnonzero(low[:, 0] < 1e-9 * low[:, 2]):
                    fitted[wide[i]] = local_value(x, y, t[i], blocks.window)
        return pa.table([rows["feature_id"].filter(pa.array(own)), pa.array(fitted[back], pa.float64())], ["feature_id", "fit"])

    return run


def loess(points: DataFrame, span: float = 0.3, block: int = 1024) -> DataFrame:
    """(feature_id, fit): local quadratic fits at all of points(feature_id, x, y), each over the span's share of all points nearest in x.

    Points are numbered along x and dealt to blocks. Tricube weights are polynomials on each side, so a fit needs only power sums of the blocks that lie whole in all windows
    of its own block (moved to the middle of the block, and from there to the point), and the points of the blocks where windows begin and end: a few
    times all points in all. The driver holds 29 numbers a block, for features that are as many as a genome has, not as many as cells. One feature gives its own y.
    """
    kept = written(points.where("x is not null and y is not null").select("feature_id", "x", "y"), "loess-points")
    spark, n = kept.sparkSession, kept.count()
    kind = kept.schema["feature_id"].dataType.simpleString()
    if not n:
        return kept.select("feature_id", F.col("y").alias("fit"))
    window = max(1, int(span * n + 1e-5))
    numbered = counts_below(kept.select("feature_id", "x", "y", F.struct("x", "feature_id").alias("_key"), F.lit(0).alias("_one"), F.lit(1).alias("_k")), ["_one"], "_key", "_k")
    numbered = written(numbered.select("feature_id", F.col("x").cast("double"), F.col("y").cast("double"), F.col("_below").cast("long").alias("nth")), "numbered")
    # as many points at one x as a window has: their own mean. There are at most a few such places
    alike = {r["x"]: r["y"] for r in numbered.groupBy("x").agg(F.count("*").alias("n"), F.avg("y").alias("y")).where(F.col("n") >= window).collect()}
    summed = sorted(numbered.groupBy(F.floor(F.col("nth") / block).alias("block")).applyInArrow(_summed(block), "block long, low double, high double, sums array<double>").collect())
    after = {r["nth"]: r["x"] for r in numbered.where((F.col("nth") >= window) & (F.pmod(F.col("nth") - window, F.lit(block)) == 0)).select("nth", "x").collect()}
    low, high = (np.array([r[c] for r in summed]) for c in ("low", "high"))
    ends = np.array([low[k] + after[k * block + window] for k in range(len(low)) if k * block + window in after])
    blocks = Blocks(n, window, block, low, high, np.array([r["sums"] for r in summed]), ends)
    pairs = spark.createDataFrame([(b, k) for b in range(len(low)) for k in blocks.needs(b)[2]], "for long, block long")
    dealt = numbered.withColumn("block", F.floor(F.col("nth") / block)).join(F.broadcast(pairs), "block")
    return dealt.groupBy("for").applyInArrow(_fit(blocks, alike), f"feature_id {kind}, fit double")


def variable_by_loess(entries: DataFrame, n_cells: int, top: int, span: float = 0.3, rescued: DataFrame | None = None) -> DataFrame:
    """(feature_id, mean, variance, fitted, standardised, rank, highly_variable) of the raw counts entries(cell_id, feature_id, value), zeros left out.

    Values count up to mean + sqrt(n_cells) times the fitted deviation. Features of no variance have the fitted logarithm 0. Ranks go by falling standardised variance, ties by
    feature_id; `top` of them are highly variable. Features of rescued(feature_id) take no part in the fit or the ranks.
    """
    own = entries if rescued is None else entries.join(rescued.select("feature_id").distinct(), "feature_id", "left_anti")
    v = F.col("value")
    sums = own.groupBy("feature_id").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    moments = sums.select("feature_id", (F.col("_s") / n_cells).alias("mean"), F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / n_cells) / max(n_cells - 1, 1), F.lit(0.0)).alias("variance"))
    moments = written(moments, "moments")
    varied = (F.col("variance") > 1e-12 * F.col("mean") * F.col("mean")) & (F.col("mean") > 0)
    fits = loess(moments.where(varied).select("feature_id", F.log10("mean").alias("x"), F.log10("variance").alias("y")), span)
    fitted = written(moments.join(fits, "feature_id", "left").select("feature_id", "mean", "variance", F.coalesce("fit", F.lit(0.0)).alias("fitted")), "fitted")
    deviation = F.pow(F.lit(10.0), F.col("fitted") / 2)
    clipped = F.least(v, F.col("mean") + deviation * float(np.sqrt(n_cells)))
    again = own.join(fitted, "feature_id").groupBy("feature_id").agg(F.sum(clipped).alias("_s"), F.sum(clipped * clipped).alias("_q"))
    spread = n_cells * F.col("mean") * F.col("mean") + F.col("_q") - 2 * F.col("mean") * F.col("_s")
    scored = written(fitted.join(again, "feature_id").select("feature_id", "mean", "variance", "fitted", (spread / (max(n_cells - 1, 1) * deviation * deviation)).alias("standardised")), "standardised")
    ranked = counts_below(scored.select("*", F.struct((-F.round("standardised", 9)).alias("s"), "feature_id").alias("_key"), F.lit(0).alias("_one"), F.lit(1).alias("_k")), ["_one"], "_key", "_k")
    return ranked.select("feature_id", "mean", "variance", "fitted", "standardised", (F.col("_below") + 1).alias("rank"), (F.col("_below") < top).alias("highly_variable"))
