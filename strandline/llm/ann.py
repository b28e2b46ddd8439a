"""Approximate nearest neighbours by balanced posting lists.

A bounded sample of the vectors gives centroids by k-means with a size penalty, their number growing with the table.
Centroids are joined in a neighbour graph that every task holds and walks best-first, for many vectors at once. Each vector is
posted to its nearest list and, near a boundary, to further lists whose centroids are not much farther and not
closer to one already taken than to the vector. A query opens the lists whose centroid is within a ratio of
its nearest one, and compares with their vectors exactly.

Equal vectors are one entry with their smallest ids from the start: no result can hold more of them than
there are places, so this loses nothing and no list grows with copies. Lists are stored as blocks of bounded
size, and a block's work is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize

ENTRY = "v binary, ids array<long>"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector of finite components, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad & some)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _rows(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _distinct(most: int):
    """Per task: each distinct vector with its `most` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[:most] for x in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.ascontiguousarray(_matrix(batch.column(1))) + 0.0
            for key, i in zip((r.tobytes() for r in m), batch.column(0).to_pylist(), strict=True):
                ids = held.setdefault(key, [])
                ids.append(i)
                if len(ids) > 64 + most:
                    ids.sort()
                    del ids[most:]
            if len(held) > 50_000:
                yield out()
                held = {}
        yield out()

    return run


def entries(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors with their `most` smallest ids."""
    part = rows.mapInArrow(_distinct(most), ENTRY)
    return part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def unit(m: np.ndarray) -> np.ndarray:
    return (m / np.sqrt((m / np.abs(m).max(axis=1, keepdims=True)) ** 2 @ np.ones(m.shape[1]))[:, None] / np.abs(m).max(axis=1, keepdims=True)).astype(np.float32)


def balanced_centroids(sample: np.ndarray, k: int, seed: int = 5, rounds: int = 12, penalty: float = 0.1, most: int = 512) -> np.ndarray:
    """k-means on unit vectors; a list's distance carries a penalty for its size beyond the mean, so that lists even out.

    Beyond `most` centroids the sample is first cut into about sqrt(k) cells and each cell gets its share of them.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    if k > most:
        cells = balanced_centroids(sample, int(k**0.5), seed, rounds, penalty)
        own = nearest_rows(sample, cells)
        out = []
        for cell in range(len(cells)):
            part = sample[own == cell]
            if len(part):
                out.append(balanced_centroids(part, min(len(part), max(1, round(k * len(part) / len(sample)))), seed + 1 + cell, rounds, penalty))
        return np.concatenate(out)
    c = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    load = np.ones(k)
    for _ in range(rounds):
        own = nearest_rows(sample, c, penalty * np.log(load))
        size = np.bincount(own, minlength=k)
        load = np.sqrt(load * np.maximum(size / (len(sample) / k), 0.1)).clip(0.3, 10)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        empty = size == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = unit(total + 1e-12)
    return c


def nearest_rows(x: np.ndarray, c: np.ndarray, cost: np.ndarray | float = 0.0, block: int = 4096) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), block):
        out[i : i + block] = (x[i : i + block] @ c.T - cost).argmax(axis=1)
    return out


class Graph:
    """Centroids and their nearest neighbours, walked best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, far: int = 4, starts: int = 32):
        self.c = centroids
        k = len(centroids)
        degree = min(degree, max(k - 1, 1))
        near = np.zeros((k, degree), np.int32)
        for lo in range(0, k, 1024):
            s = centroids[lo : lo + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
            near[lo : lo + len(s)] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        # a few far links keep separate regions in reach
        self.links = np.concatenate([near, np.random.Generator(np.random.PCG64(3)).integers(0, k, (k, far), dtype=np.int32)], axis=1)
        self.start = np.unique(np.linspace(0, k - 1, min(k, starts)).astype(np.int32))

    def _sims(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nld->nl", x, self.c[ids])

    def search(self, x: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and cosines of up to `width` centroids of each row, best first.

        Each row has a beam of the best `width` centroids it has met; a hop opens the best `expand` of them that are not open yet and
        keeps the best of what they link to. Rows end when their whole beam is open. What is held is a few beams a row,
        whatever the number of centroids.
        """
        n, k = len(x), len(self.c)
        width = min(width, k)
        first = np.tile(self.start, (n, 1))
        ids, sims = self._best(first, self._sims(x, first), np.zeros(first.shape, bool), width)[:2]
        done = np.zeros(ids.shape, bool)
        active = np.arange(n)
        while len(active):
            s = np.where(done[active] | (ids[active] < 0), -4, sims[active])
            pick = np.argpartition(-s, min(expand, s.shape[1]) - 1, axis=1)[:, :expand]
            live = np.take_along_axis(s, pick, axis=1) > -3
            go = live.any(axis=1)
            active, pick, live = active[go], pick[go], live[go]
            if not len(active):
                break
            own_done = done[active]
            np.put_along_axis(own_done, pick, True, axis=1)
            opened = np.take_along_axis(ids[active], pick, axis=1)
            nbr = np.where(live[:, :, None], self.links[np.maximum(opened, 0)], -1).reshape(len(active), -1)
            new = self._sims(x[active], np.maximum(nbr, 0))
            both = np.concatenate([ids[active], nbr], axis=1)
            ids[active], sims[active], done[active] = self._best(both, np.concatenate([sims[active], new], axis=1), np.concatenate([own_done, np.zeros(nbr.shape, bool)], axis=1), width)
        return ids, sims

    @staticmethod
    def _best(ids: np.ndarray, sims: np.ndarray, done: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The `width` best distinct ids of each row, best first; of equal ids the one that is open counts. Places without one have id -1."""
        order = np.lexsort((~done, ids), axis=1)
        ids, sims, done = (np.take_along_axis(a, order, axis=1) for a in (ids, sims, done))
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        sims = np.where(again | (ids < 0), -3.0, sims).astype(np.float32)
        if ids.shape[1] < width:
            ids, sims, done = (np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=v) for a, v in ((ids, -1), (sims, -3.0), (done, True)))
        top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims, done = (np.take_along_axis(a, top, axis=1) for a in (ids, sims, done))
        return np.where(sims > -3, ids, -1), sims, done | (sims <= -3)


def _post(graph: Graph, copies: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x = unit(_rows(batch.column(0)))
                top, sim = graph.search(x, copies * 2)
                dist = np.sqrt(np.maximum(2 - 2 * sim, 0))
                take = np.zeros(top.shape, bool)
                take[:, 0] = True
                dist[top < 0] = np.inf
                for j in range(1, top.shape[1]):
                    # not if a centroid already taken is closer to this one than the vector is
                    between = np.sqrt(np.maximum(2 - 2 * np.einsum("nld,nd->nl", graph.c[top[:, :j]], graph.c[top[:, j]]), 0))
                    hidden = (take[:, :j] & (between < dist[:, j : j + 1])).any(axis=1)
                    take[:, j] = (dist[:, j] <= (1 + slack) * dist[:, 0]) & ~hidden & (take.sum(axis=1) < copies)
                r, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(top[r, j], pa.int32()), *(c.take(pa.array(r)) for c in batch.columns)], ["list", "v", "ids"])

    return run


def _open(graph: Graph, most: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                m = np.ascontiguousarray(_matrix(batch.column(1)))
                top, sim = graph.search(unit(m), most)
                dist = np.where(top < 0, np.inf, np.sqrt(np.maximum(2 - 2 * sim, 0)))
                r, j = np.nonzero(dist <= ratio * dist[:, :1] + 1e-6)
                bytes_ = pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(top[r, j], pa.int32()), batch.column(0).take(pa.array(r)), bytes_.take(pa.array(r))], ["list", "id", "q"])

    return run


def exact_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision; vectors are scaled by their largest component first, so that no square overflows."""
    a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (q, x))
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))


def _compare(k: int):
    """Co-grouped block of a list: its vectors and a share of the queries that open it, to each query's best k."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        q, ids = _rows(right["q"]), left["ids"].combine_chunks()
        v = _rows(left["v"])
        flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        at, count = at - at[0], np.diff(at)
        qid = right["id"].to_numpy()
        out: list[tuple] = []
        for lo in range(0, len(q), 512):
            s = exact_cosines(q[lo : lo + 512], v)
            keep = min(k + 1, s.shape[1])
            bar = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
            for r in range(len(s)):
                near = np.flatnonzero(s[r] >= bar[r])
                owner = np.repeat(near, count[near])
                cand = np.concatenate([flat[at[e] : at[e + 1]] for e in near.tolist()])
                score = s[r][owner]
                other = cand != qid[lo + r]
                cand, score = cand[other], score[other]
                best = np.lexsort((cand, -score))[:k]
                out += [(int(qid[lo + r]), int(c), float(x)) for c, x in zip(cand[best], score[best], strict=True)]
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **sizes) -> DataFrame:
    """Each query's k nearest vectors found, by cosine: query_id, rank from 1, vec_id and score.

    vectors and queries have id_col and vec_col; a query's own id is never its result. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids; vectors of different lengths are never compared, so each length has an
    index of its own. Ties go to the smaller id. With fewer than k candidates found all are returned. Rows of the same id and
    vector count once; a query id with several vectors asks with the first of them in order. Extra columns are ignored.
    """
    rows = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    out = None
    for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        found = nearest_of_length(rows.where(F.size("v") == r["n"]), asked.where(F.size("v") == r["n"]), k, r["n"], **sizes)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else asked.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))


def nearest_of_length(rows: DataFrame, asked: DataFrame, k: int, dim: int, list_size: int = 160, most_lists: int = 1 << 15, sample_bytes: int = 96 << 20, copies: int = 6, slack: float = 0.35, open_lists: int = 48, ratio: float = 1.3, block: int = 2048, query_block: int = 1 << 14) -> DataFrame:
    """nearest for rows (id, v) and asked (id, v) that all have dim components.

    There is one list for every list_size distinct vectors, most_lists at most: their centroids (2 MB for each 16
    dimensions at most) and graph (4 MB) are what tasks hold. They are fitted on about 8 vectors a list, within sample_bytes as 32-bit floats.
    Every vector is posted to up to `copies` lists.
    """
    index = materialize(entries(rows, k + 1), "ann-entries")
    n = index.count()
    sample_rows = max(256, min(8 * max(1, min(n // list_size, most_lists)), sample_bytes // (4 * dim)))
    some = index.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000_000)) < 1e9 * sample_rows / n) if n > sample_rows else index
    raw = some.select("v").toArrow()["v"].combine_chunks()
    sample = np.concatenate([unit(_rows(raw.slice(i, 4096))) for i in range(0, max(len(raw), 1), 4096)]) if len(raw) else unit(_rows(index.limit(1).select("v").toArrow()["v"].combine_chunks()))
    sample = sample[np.lexsort(sample.T)]
    lists = int(min(max(1, n // list_size), most_lists, max(1, len(sample) // 2)))
    graph = Graph(balanced_centroids(sample, lists))
    posted = materialize(index.mapInArrow(_post(graph, copies, slack), "list int, " + ENTRY), "ann-lists")
    opened = asked.mapInArrow(_open(graph, open_lists, ratio), "list int, id long, q binary")
    opened = materialize(opened, "ann-opened")

    def shares(rows: DataFrame, size: int) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))

    blocks = shares(posted, block).withColumnRenamed("n", "blocks").join(shares(opened, query_block).withColumnRenamed("n", "asks"), "list")
    left = posted.join(blocks, "list").withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    right = opened.join(blocks, "list").withColumn("a", F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    pairs = left.select("list", "b", "a", "v", "ids").groupBy("list", "b", "a").cogroup(right.select("list", "b", "a", "id", "q").groupBy("list", "b", "a"))
    found = pairs.applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
