"""Document quality by histogram gradient-boosted trees over document statistics.

One pass over the texts gives every document a vector of statistics. Trees grow level by level on feature
histograms of gradients; they are complete binary trees kept in flat arrays, so that scoring is a few
array gathers per level for many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import id_crc, materialize
from strandline.llm.textkernel import chunk_ranges, mix, span_hashes, utf8, word_spans

MARKS = b".,!?|#:;-\"'()<>/=_*"
FEATURES = ["log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "space", "mark", "wide", *(f"mark_{c}" for c in MARKS), "log_lines", "line_mean", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "entropy", "short_words", "long_words", "capital_words", "stop_lines"]


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each owner, and the count of its most frequent one."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(50)) | (h >> np.uint64(14)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    who = (key[at] >> np.uint64(50)).astype(np.int64)
    top = np.zeros(n)
    if len(at):
        first = np.flatnonzero(np.diff(who, prepend=-1))
        top[who[first]] = np.maximum.reduceat(np.diff(np.append(at, len(key))), first)
    return np.bincount(who, minlength=n).astype(float), top


def statistics(data: np.ndarray, off: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, h: np.ndarray | None = None) -> np.ndarray:
    """One row of FEATURES for each document; an empty one has zeros. Word spans and their hashes are taken where they are known."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    owner = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    some = np.maximum(size, 1)
    share = counts / some[:, None]
    s, e, at = spans or word_spans(data, off)
    words = np.diff(at)
    many = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    length = (e - s).astype(float)
    mean = np.bincount(doc, length, n) / many
    sd = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / many - mean * mean, 0))
    h = span_hashes(data, s, e) if h is None else h
    distinct, top = _distinct(doc, h, n) if len(h) else (np.zeros(n), np.zeros(n))
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(h) else np.zeros(0, int)
    pairs = _distinct(doc[pair], mix(h[pair] * np.uint64(3) + h[pair + 1]), n)[0] if len(pair) else np.zeros(n)
    ends = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate([off[:-1][size > 0], ends + 1]))
    line_at = line_at[line_at < len(data)]
    line_to = np.append(line_at[1:], len(data)) if len(line_at) else line_at
    line_doc = owner[line_at] if len(line_at) else np.zeros(0, int)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    line_kinds = _distinct(line_doc, span_hashes(data, line_at, line_to), n)[0] if len(line_at) else np.zeros(n)
    stop = np.isin(data[ends[ends > 0] - 1], np.frombuffer(b".!?", np.uint8))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    first = data[s] if len(s) else np.zeros(0, np.uint8)
    upper = counts[:, 65:91].sum(axis=1)
    letters = np.maximum(upper + counts[:, 97:123].sum(axis=1), 1)
    full = np.maximum(lines, 1)
    columns = [
        np.log1p(size), np.log1p(words), mean, sd, upper / letters, share[:, 48:58].sum(axis=1), share[:, [32, 9, 10, 11, 12, 13]].sum(axis=1),
        share[:, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]].sum(axis=1), share[:, 128:].sum(axis=1),
        *(share[:, c] for c in MARKS),
        np.log1p(lines), size / full, distinct / many, top / many, pairs / np.maximum(words - 1, 1), line_kinds / full, entropy,
        np.bincount(doc, length <= 3, n) / many, np.bincount(doc, length >= 12, n) / many,
        np.bincount(doc, (first >= 65) & (first <= 90), n) / many, np.bincount(owner[ends[ends > 0]], stop, n) / full if len(data) else np.zeros(n),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column(1))
        for i, j in chunk_ranges(off):
            x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


class Trees:
    """Complete trees of one depth in flat arrays: for each node its feature and threshold, for each leaf its value."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 5, bins: int = 48, rate: float = 0.15, l2: float = 2.0, least: float = 3.0) -> Trees:
    """Boost `rounds` trees for labels y in 0..1 by second-order gain on histograms of at most `bins` quantile bins."""
    n, f = x.shape
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    trees = Trees(depth, float(np.log(mean / (1 - mean))))
    if n == 0 or y.min() == y.max():
        return trees
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(f)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], "left") for k in range(f)], axis=1)
    flat = binned + np.arange(f) * bins
    total = np.full(n, trees.base)
    edge = np.full((f, bins), np.inf)
    for k in range(f):
        edge[k, : len(cuts[k])] = cuts[k]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            here = 2**level
            key = (node[:, None] * (f * bins) + flat).ravel()
            gh = [np.bincount(key, np.repeat(w, f), here * f * bins).reshape(here, f, bins).cumsum(axis=2) for w in (g, h)]
            (gl, hl), (ga, ha) = gh, (a[:, :, -1:] for a in gh)
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < least) | (ha - hl < least) | ~np.isfinite(edge)[None]] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            good = gain.reshape(here, -1)[np.arange(here), best] > 1e-9
            k, b = best // bins, best % bins
            at = 2**level - 1 + np.arange(here)
            feature[at], threshold[at] = k, np.where(good, edge[k, b], np.inf)
            node = 2 * node + (x[np.arange(n), k[node]] > threshold[at][node])
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = rate * gs / (hs + l2)
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.leaf.append(leaf)
        total += leaf[node]
    return trees


def _score(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(trees.score(x), pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, label_rows: int = 30_000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels (doc_id, quality) teach only for ids whose crc32 is not 0 modulo folds, at most about label_rows
    of them, chosen by a hash of the id; a repeated label counts as often (16 times at most, a weight), a null one not at all.
    Of documents with the same id one, by its statistics, is learnt from. Null texts count
    as empty, and empty ones get the score of their statistics. Without usable labels every score is 0.5, or near
    the one label there is.
    """
    held = F.pmod(id_crc(), F.lit(folds)) == 0
    x = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, "doc_id long, x binary"), "quality-statistics")
    y = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(~held)
    n = y.count()
    if n > label_rows:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < 1e6 * label_rows / n)
    # one row a document and label value, so that neither repeated documents nor repeated labels outgrow the sample
    rows = y.groupBy("doc_id", "y").agg(F.count("*").alias("times")).join(x, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"), F.min("times").alias("times")).toPandas().sort_values(["doc_id", "y"])
    rows = rows.loc[rows.index.repeat(rows["times"].clip(upper=16))]
    matrix = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), len(FEATURES))
    trees = fit_trees(matrix, rows["y"].to_numpy(float))
    scored = x.select("doc_id", held.alias("held_out"), "x").mapInArrow(_score(trees), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
