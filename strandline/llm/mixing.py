"""Mixing documents to target domain weights with soft memberships.

A classifier learnt from a labelled table gives every document posteriors over domains. Rates between 0 and a most
that a document may be repeated, one for each document, are then fitted so that the expected token totals of the domains
meet targets: nonnegative least squares on the totals, each error relative to its target, with a small pull of each rate
to 1. The rates are projected gradient steps whose gradient is one vector, a number for each domain; Newton steps on these numbers find it, each a pass over the
documents' posteriors that returns sums of a fixed number, and a document's own rate follows from its posteriors and
that vector, so no rate is stored. The domain of the largest weight keeps its total where that can be. Tokens are those of the tokenizer that packing uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.llm.quality import FEATURES, statistics
from strandline.llm.textkernel import chunk_ranges, span_hashes, utf8, word_spans
from strandline.llm.tokens import default_path, encode_column

HASHED = 1 << 16
#: A document's words weigh one over this power of their number.
SCALE = 0.05
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.90, 0.08, 0.02)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each document, without a mark at either end (flat, and where each document's begin), and its statistics."""
    n = len(off) - 1
    s, e, at = word_spans(data, off)
    h = span_hashes(data, s, e)
    stats = statistics(data, off, (s, e, at), h)
    # bare words, hashed anew only where a mark was cut off
    head, tail = _MARK[data[s]] & (e - s > 1), _MARK[data[e - 1]] & (e - s > 2)
    bare = np.flatnonzero(head | tail)
    h[bare] = span_hashes(data, s[bare] + head[bare], e[bare] - tail[bare])
    key = np.sort(np.repeat(np.arange(n), np.diff(at)) * HASHED + (h >> np.uint64(40)).astype(np.int64) % HASHED)
    key = key[np.diff(key, prepend=-1) > 0]
    return key % HASHED, np.searchsorted(key, np.arange(n + 1) * HASHED), stats


@dataclass
class Classifier:
    """Softmax regression over hashed word presence and standardised statistics."""

    word: np.ndarray
    stat: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, ids: np.ndarray, at: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        logits = np.clip((stats - self.mean) / self.scale, -5, 5) @ self.stat + self.bias
        some = np.flatnonzero(n)
        if len(some):
            logits[some] += np.add.reduceat(self.word[ids], at[some], axis=0) / n[some, None] ** SCALE
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column(1))
        for i, j in chunk_ranges(off):
            ids, at, stats = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array([s.tobytes() for s in stats], pa.binary())], ["domain", "ids", "stats"])


def fit_classifier(docs: DataFrame, labels: DataFrame, label_rows: int = 12_000, epochs: int = 12, seed: int = 9) -> Classifier:
    """Fit on at most about label_rows documents of labels(doc_id, domain), chosen by a hash of the id; domain counts from 0, other rows do not count, and of an id's labels the last domain does."""
    k = len(DOMAINS)
    own = labels.where(F.col("domain").between(0, k - 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("int").alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    n = own.count()
    if n > label_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1_000_000)) < 1e6 * label_rows / n)
    # of documents with the same id the first by text, so that repeated rows do not outgrow the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min("text").alias("text"))
    got = rows.select("domain", "text").mapInArrow(_extract, "domain int, ids array<int>, stats binary").toArrow().combine_chunks()
    model = Classifier(np.zeros((HASHED, k)), np.zeros((len(FEATURES), k)), np.zeros(k), np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    if not got.num_rows:
        return model
    y = got["domain"].to_numpy()
    lists = got["ids"].combine_chunks()
    ids, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    at = at - at[0]
    stats = np.frombuffer(b"".join(got["stats"].to_pylist()), np.float32).reshape(len(y), -1).astype(float)
    # a fixed order, whatever order tasks end in
    order = np.lexsort((np.diff(at), *stats.T, y))
    model.mean, model.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    rng = np.random.Generator(np.random.PCG64(seed))
    state = [np.full_like(m, 1e-4) for m in (model.word, model.stat, model.bias)]
    for _ in range(epochs):
        mixed = rng.permutation(order)
        for lo in range(0, len(mixed), 256):
            part = mixed[lo : lo + 256]
            size = at[part + 1] - at[part]
            begin = np.concatenate([[0], np.cumsum(size)])
            flat = ids[np.repeat(at[part] - begin[:-1], size) + np.arange(begin[-1])]
            error = model.posteriors(flat, begin, stats[part]) - np.eye(k)[y[part]]
            value = error / np.maximum(size, 1)[:, None] ** SCALE
            touched, place = np.unique(flat, return_inverse=True)
            spread = np.repeat(value, size, axis=0)
            word = np.stack([np.bincount(place, spread[:, c], len(touched)) for c in range(k)], axis=1) / len(part)
            stat = np.clip((stats[part] - model.mean) / model.scale, -5, 5).T @ error / len(part) + 1e-4 * model.stat
            for m, s, g, rows_ in ((model.word, state[0], word + 1e-6 * model.word[touched], touched), (model.stat, state[1], stat, slice(None)), (model.bias, state[2], error.mean(axis=0), slice(None))):
                s[rows_] += g * g
                m[rows_] -= 0.1 * g / np.sqrt(s[rows_])
    return model


@dataclass
class Rates:
    """The multipliers that give a document's rate from its posteriors, with the totals asked for and reached.

    status: met, scarce (domains too rare for their targets miss them), skewed (no lowering of the total brings the others to their shares),
    limit (passes ran out; the best rates so far) or empty (no tokens, or posteriors of no model: all rates are 1).
    """

    most: float
    multipliers: np.ndarray
    target: np.ndarray
    reached: np.ndarray
    status: str = "met"
    passes: int = 0

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.clip(1 - p @ self.multipliers, 0, self.most)


def sums_of(p: np.ndarray, t: np.ndarray, multipliers: np.ndarray, most: float) -> np.ndarray:
    """For each row of multipliers: the domains' totals, the free documents' second moments and the potential, over documents of posteriors p and t tokens."""
    k = p.shape[1]
    out = np.zeros((len(multipliers), k + k * k + 1))
    for row, m in zip(out, multipliers, strict=True):
        z = p @ m
        r = np.clip(1 - z, 0, most)
        row[:k] = (r * t) @ p
        free = (r > 0) & (r < most)
        row[k:-1] = (p[free].T @ (p[free] * t[free, None])).ravel()
        row[-1] = t @ np.where(z >= 1, -0.5, np.where(z <= 1 - most, -most * z - (most - 1) ** 2 / 2, z * z / 2 - z))
    return out


def _sums(multipliers: np.ndarray, most: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(multipliers), k + k * k + 1))
        for batch in batches:
            p = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, k)
            total += sums_of(p, batch.column(1).to_numpy().astype(float), multipliers, most)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "x"])

    return run


def targets_of(now: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Target totals in the ratio of the weights: the domain of the largest weight that has any tokens keeps its own."""
    w = weights / weights.sum()
    some = np.flatnonzero((w > 0) & (now > 0))
    return w * (now[some[w[some].argmax()]] / w[some].max()) if len(some) else np.zeros(len(w))


#: Parts of a Newton step that one pass tries.
STEPS = np.array([1.0, 0.3, 0.05, 0.003])


def solve(evaluate, targets: np.ndarray, scale: np.ndarray, pull: float, start: np.ndarray, passes: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Multipliers and totals for each row of targets, all in the same passes; which settled, and how many passes it took.

    The least squares of (total - target) / scale with a pull of each token's rate to 1 have rates that are projected gradient steps from 1, clip(1 - p m), for
    one vector m of multipliers, the minimum of a convex function of as many variables as domains. Newton steps find it; a
    pass evaluates several lengths of the step, and the best one is taken.
    """
    k = targets.shape[1]
    stiff = pull * scale**2 / np.maximum(targets.sum(axis=1, keepdims=True), 1e-300)

    def look(m: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = evaluate(m)
        return got, (stiff[own] * m * m).sum(axis=1) / 2 + (targets[own] * m).sum(axis=1) + got[:, -1]

    m = start.copy()
    rows = np.arange(len(m))
    got, value = look(m, rows)
    used = 1
    live = rows
    while used < passes:
        slope = stiff * m + targets - got[:, :k]
        live = rows[(np.abs(slope) > 1e-4 * scale).any(axis=1) & np.isin(rows, live)]
        if not len(live):
            break
        bend = got[live, k:-1].reshape(-1, k, k) + stiff[live][:, :, None] * np.eye(k)
        bend += np.trace(bend, axis1=1, axis2=2)[:, None, None] * 1e-9 * np.eye(k)
        way = -np.linalg.solve(bend, slope[live][:, :, None])[:, :, 0]
        way *= np.minimum(1, 4 * np.maximum(1, np.abs(m[live]).max(axis=1)) / np.maximum(np.abs(way).max(axis=1), 1e-300))[:, None]
        tried = (m[live][:, None] + STEPS[None, :, None] * way[:, None]).reshape(-1, k)
        own = np.repeat(live, len(STEPS))
        new, values = look(tried, own)
        used += 1
        best = values.reshape(-1, len(STEPS)).argmin(axis=1) + np.arange(len(live)) * len(STEPS)
        better = values[best] < value[live] - 1e-13 * np.abs(value[live])
        took, at = live[better], best[better]
        m[took], got[took], value[took] = tried[at], new[at], values[at]
        # one that no step betters is as near as numbers go
        live = took
    return m, got[:, :k], ~np.isin(rows, live), used


def fit_multipliers(evaluate, now: np.ndarray, weights: np.ndarray, pull: float, most: float, close: float) -> Rates:
    """Rates whose totals meet the weights; see fit_rates. evaluate gives sums_of for rows of multipliers, now are the totals at rates of 1."""
    k = len(weights)
    full = targets_of(now, weights)
    if not full.sum() > 0:
        return Rates(most, np.zeros(k), full, now, "empty")
    used, main = 0, int(full.argmax())

    def fitted(shares: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Multipliers, totals, the largest excess or the main domain's lack, and what settled, for shares of the full target; other domains that miss theirs no longer push."""
        nonlocal used
        targets = shares[:, None] * full
        scale = np.maximum(targets, 1e-3 * targets.sum(axis=1, keepdims=True))
        m, reached, done, n = solve(evaluate, targets, scale, pull, start)
        used += n
        scarce = reached < targets * (1 - close)
        scarce[:, main] = False
        push = scarce.any(axis=1) & (reached > targets + close * scale).any(axis=1)
        if push.any():
            wide = np.where(scarce, 30 * scale, scale)
            m[push], reached[push], done[push], n = solve(evaluate, targets[push], wide[push], pull, m[push])
            used += n
        return m, reached, np.maximum(((reached - targets) / scale).max(axis=1), 1 - reached[:, main] / targets[:, main]), done

    shares, zero = np.ones(1), np.zeros((1, k))
    m, reached, over, done = fitted(shares, zero)
    if over[0] > 2.5 * close:
        # the main domain's total is out of reach: the largest one at which the common domains meet their shares
        shares = np.exp2(-np.arange(1, 17) / 2.0)
        m, reached, over, done = fitted(shares, np.repeat(m, len(shares), axis=0))
        good = np.flatnonzero(over <= 2.5 * close)
        if len(good):
            low, high, kept = shares[good[0]], 2**0.5 * shares[good[0]], m[good[0]]
            finer = np.append(np.linspace(high, low, 16, endpoint=False)[1:], low)
            m, reached, over, done = fitted(finer, np.repeat(kept[None], len(finer), axis=0))
            shares = finer
            good = np.flatnonzero(over <= 2.5 * close)
        best = good[0] if len(good) else int(np.argmin(np.round(over, 2)))
        shares, m, reached, over, done = (x[best : best + 1] for x in (shares, m, reached, over, done))
    target = shares[0] * full
    status = "limit" if not done[0] else "skewed" if over[0] > 2.5 * close else "scarce" if (reached[0] < target * (1 - 2.5 * close)).any() else "met"
    return Rates(most, m[0], target, reached[0], status, used)


def fit_rates(members: DataFrame, weights: tuple[float, ...] = TARGETS, pull: float = 0.001, most: float = 4.0, close: float = 2e-3) -> Rates:
    """Rates from 0 to `most` for members(p, n_tokens) whose expected domain totals meet the weights.

    Least squares of the totals' errors, each relative to its target. Targets keep the main domain's total (that of the largest weight) where that can be, or else the
    largest part of it at which it is reached and no domain exceeds its share, by 2.5 `close`. Another domain too scarce for its target misses it, and its error then counts a thousandth, so that
    it does not raise the others. Nothing is raised: status tells what was met, reached the totals.
    """
    k = len(weights)

    def evaluate(multipliers: np.ndarray) -> np.ndarray:
        rows = members.mapInArrow(_sums(multipliers, most, k), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        x = np.zeros(len(multipliers) * (k + k * k + 1))
        for r in rows:
            x[r["k"]] = r["x"]
        return x.reshape(len(multipliers), -1)

    return fit_multipliers(evaluate, evaluate(np.zeros((1, k)))[0, :k], np.array(weights, float), pull, most, close)


def _posteriors(model: Classifier, column: int, path: str):
    """Adds p and n_tokens to rows whose text is in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(column))
            for i, j, token_ids, token_at in encode_column(batch.column(column), path):
                ids, at, stats = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                p = model.posteriors(ids, at, stats)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array([x.tobytes() for x in p], pa.binary()), pa.array(np.diff(token_at).astype(np.int64))], [*batch.schema.names, "_p", "_n_tokens"])

    return run


def domain_labels(labels: DataFrame) -> DataFrame:
    """Domains of labels(doc_id, quality, toxic): toxic rows, then poor ones, then good ones; null where that can't be told."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", domain.alias("domain"))


def _rated(rates: Rates):
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(p[:, c])) for c in range(k)), pa.array(rates.of(p))], ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate"])

    return run


def copies(rate: str, doc_id: str):
    """Whole copies for a rate: rounded up or down by a hash of the id, so that the expected number is the rate."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1_000_000)) / 1e6
    return F.floor(F.col(rate) + u).cast("int")


def schema_of(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def fit(docs: DataFrame, labels: DataFrame, keep: list[str], weights: tuple[float, ...] = TARGETS, path: str | None = None) -> tuple[DataFrame, Rates]:
    """The columns `keep` of docs with posteriors _p and _n_tokens, written once, and the rates."""
    model = fit_classifier(docs, domain_labels(labels))
    frame = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").cast("string").alias("text"))
    rows = frame.mapInArrow(_posteriors(model, frame.columns.index("text"), path or default_path()), schema_of(frame) + "_p binary, _n_tokens long")
    members = materialize(rows.select(*keep, "_p", "_n_tokens"), "mix-members")
    if not (model.word.any() or model.stat.any() or model.bias.any()):
        return members, Rates(4.0, np.zeros(len(weights)), np.zeros(len(weights)), np.zeros(len(weights)), "empty")
    return members, fit_rates(members.select("_p", "_n_tokens"), weights)


def mixture(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, posteriors p_<domain>, rate and copies of every row of documents(doc_id, text, ...).

    Null texts count as empty: no tokens, and the posteriors of their statistics. Without labels all posteriors are equal,
    and all rates are 1. Repeated rows have equal rates and copies; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members, rates = fit(docs, labels, ["doc_id"], weights)
    out = members.select("doc_id", "_p", "_n_tokens").mapInArrow(_rated(rates), "doc_id long, n_tokens long, " + "".join(f"p_{d} double, " for d in DOMAINS) + "rate double")
    return out.withColumn("copies", copies("rate", "doc_id"))


def _rate_column(rates: Rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.frombuffer(b"".join(batch.column(batch.num_columns - 2).to_pylist()), np.float64).reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rates.of(p))], [*batch.schema.names[:-2], "_rate"])

    return run


def mix(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = TARGETS) -> DataFrame:
    """docs with each row as often as its copies say, other columns as they are; rows are handled as mixture says."""
    members, rates = fit(docs, labels, docs.columns, weights)
    rated = members.mapInArrow(_rate_column(rates), schema_of(docs) + "_rate double").withColumn("_copies", copies("_rate", "doc_id")).where("_copies > 0")
    return rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
