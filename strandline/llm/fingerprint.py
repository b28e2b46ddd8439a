"""Improbable-feature digests of documents.

Every 64-byte window of a text has a collision entropy; how rare that entropy is over the whole table ranks
the window. Windows that are the rarest of their neighbourhood often enough are the text's features. They
go into a chain of 2048-bit Bloom filters of 160 features each, and two texts compare by the overlap of their filters'
bits beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_parts
from strandline.llm.textkernel import chunk_ranges, mix, random_odds, utf8

WINDOW = 64
KINDS = WINDOW * (WINDOW - 1) // 2 + 1
BITS, FILL, HASHES = 2048, 160, 5
CHUNK = 1 << 19
_ODD = random_odds(WINDOW // 8, 77)


def window_pairs(data: np.ndarray) -> np.ndarray:
    """Equal byte pairs of every 64-byte window: few mean a high collision entropy, log2(64**2 / (64 + 2 * pairs))."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    step = back[WINDOW:].astype(np.int32) - ahead[:-WINDOW]
    counts = np.bincount(data[:WINDOW])
    return np.concatenate([[int((counts * (counts - 1) // 2).sum())], step]).cumsum(dtype=np.int32)


def _valid(off: np.ndarray, n: int) -> np.ndarray:
    """Whether the window that starts at a byte lies in one document."""
    edge = np.zeros(n + 1, np.int32)
    size = np.diff(off)
    full = np.flatnonzero(size >= WINDOW)
    edge[off[full]] += 1
    np.add.at(edge, off[full + 1] - WINDOW + 1, -1)
    return np.cumsum(edge[:n]) > 0


def _entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(KINDS, np.int64)
    for batch in batches:
        data, off = utf8(batch.column(0))
        for i, j in chunk_ranges(off, CHUNK):
            part = data[off[i] : off[j]]
            if len(part) >= WINDOW:
                pairs = window_pairs(part)
                total += np.bincount(pairs[_valid(off[i : j + 1] - off[i], len(part))[: len(pairs)]], minlength=KINDS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pairs", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each window entropy by how few of all windows have it, the rarest first; those not met come last."""
    counts = np.zeros(KINDS, np.int64)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(_entropies, "pairs long, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect():
        counts[r["pairs"]] = r["n"]
    order = np.lexsort((np.arange(KINDS), np.where(counts > 0, counts, np.iinfo(np.int64).max)))
    rank = np.empty(KINDS, np.int64)
    rank[order] = np.arange(KINDS)
    return rank


def digests(texts: list[bytes], rank: np.ndarray, popular: int = 16) -> list[np.ndarray]:
    """The Bloom chain of each text, filters x 32 words of 64 bits. A text below 64 bytes is one feature; an empty one has no filter."""
    size = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, m = len(texts), max(len(data) - WINDOW + 1, 0)
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if m:
        valid = _valid(off, len(data))[:m]
        key = np.where(valid, (rank[window_pairs(data)] << 40) | np.arange(m), np.iinfo(np.int64).max)
        low, span = key, 1
        while span < WINDOW:
            low = np.minimum(low, np.concatenate([low[span:], np.full(min(span, len(low)), np.iinfo(np.int64).max)])[: len(low)])
            span *= 2
        votes = np.bincount(low[valid] & ((1 << 40) - 1), minlength=m)
        at = np.flatnonzero(votes >= popular)
        owner = np.searchsorted(off, at, "right") - 1
        none = np.setdiff1d(np.flatnonzero(size >= WINDOW), owner)
        if len(none):
            best = np.array([key[off[d] : off[d + 1] - WINDOW + 1].min() & ((1 << 40) - 1) for d in none], np.int64)
            at, owner = np.concatenate([at, best]), np.concatenate([owner, none])
        words = np.ascontiguousarray(data[at[:, None] + np.arange(WINDOW)]).view(np.uint64)
        docs.append(owner)
        hashes.append(mix((words * _ODD).sum(axis=1, dtype=np.uint64)))
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    if len(short):
        docs.append(short)
        hashes.append(np.array([int.from_bytes(hashlib.blake2b(texts[d], digest_size=8).digest(), "little") for d in short], np.uint64))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], h[order]
    first = np.sort(np.unique(np.stack([doc.astype(np.uint64), h]), axis=1, return_index=True)[1]) if len(h) else np.zeros(0, int)
    doc, h = doc[first], h[first]
    count = np.bincount(doc, minlength=n)
    filters = -(-count // FILL)
    base = np.concatenate([[0], np.cumsum(filters)])
    chain = base[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) // FILL
    bits = np.zeros((int(base[-1]), BITS), np.uint8)
    for k in range(HASHES):
        bits[chain, (h >> np.uint64(11 * k)).astype(np.int64) % BITS] = 1
    packed = np.packbits(bits, axis=1).view(np.uint64)
    return [packed[base[d] : base[d + 1]] for d in range(n)]


def likeness(x: np.ndarray, y: np.ndarray, chance: float = 0.1) -> float:
    """Mean over the shorter chain's filters of the best bit overlap with a filter of the other, 0 at chance and 1 if one holds the other."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return float(len(y) == 0)
    nx, ny = np.bitwise_count(x).sum(axis=1).astype(float), np.bitwise_count(y).sum(axis=1).astype(float)
    total = 0.0
    for k in range(len(x)):
        both = np.bitwise_count(x[k] & y).sum(axis=1).astype(float)
        most, least = np.minimum(nx[k], ny), nx[k] * ny / BITS
        floor = least + chance * (most - least)
        total += float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(x)


def _text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket and order; a row flagged ahead is the document after the bucket's last."""

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """Rows of all but the last of (doc_id, text)."""
            own, nxt = rows[:-1], rows[1:]
            edited = []
            for (_, t), (_, u) in zip(own, nxt, strict=True):
                half = len(t) // 2
                edited.append((t[: len(t) - half] + u[:half]).encode())
            chains = digests([t.encode() for _, t in rows] + edited, rank)
            plain, changed = chains[: len(rows)], chains[len(rows) :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in own], pa.int64()),
                    pa.array([len(t) for _, t in own], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([_text(c) for c in plain[:-1]]),
                    pa.array([_text(c) for c in changed]),
                    pa.array([likeness(a, b) for a, b in zip(plain, changed, strict=False)]),
                    pa.array([likeness(a, b) for a, b in zip(plain, plain[1:], strict=False)]),
                ],
                [c.split()[0] for c in ROWS.split(", ")],
            )

        held: list[tuple] = []
        size = 0
        over = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, text, ahead in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if ahead and over:
                        continue
                    over = bool(ahead)
                    held.append((doc, text))
                    size += len(text)
                    if over or size > CHUNK // 2 and len(held) > 1:
                        yield out(held)
                        held, size = ([], 0) if over else (held[-1:], len(text))

    return run


LEAST, MOST = -(1 << 63), (1 << 63) - 1
HALF = 1 << 62
#: A range of documents has a megabyte of text or more; beyond 64 MB a range there are more ranges than shuffle partitions, up to 2^15.
RANGE_LEAST, RANGE_MOST, RANGES = 20, 26, 1 << 15


def range_cuts(base: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ranges but the first, as (falling, hash) in rising order.

    Quantiles of the ids, from a sketch; an id that several of them fall on is cut as often along the hashes of its texts.
    """
    found = base.stat.approxQuantile("place", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    times = Counter(min(max(int(c), LEAST), MOST) for c in found)
    cuts = []
    for place in sorted(times, reverse=True):
        # null ids have hashes of the upper half
        low = HALF if place == LEAST else 0
        cuts += [(~place, 0)] + [(~place, low + j * HALF // times[place]) for j in range(1, times[place])]
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def range_of(falling: np.ndarray, hashes: np.ndarray, ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How many starts (falling, hash) lie at or before each row (ids, texts)."""
    low, high = np.searchsorted(falling, ids, "left"), np.searchsorted(falling, ids, "right")
    out = low.copy()
    for at in np.unique(low[high > low]):
        rows = (low == at) & (high > low)
        stop = int(high[np.argmax(rows)])
        out[rows] = at + np.searchsorted(hashes[at:stop], texts[rows], "right")
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents(doc_id, text, ...), of their edited texts, and likenesses.

    The next document is the one after in falling doc_id, rows of equal id in the order of a hash of their text, null ids last, and
    the first after the last. The edited text has the last half of the code points replaced by the next document's first. One row
    per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty and have an empty fingerprint, alike only to each other. Extra columns are ignored.

    Documents are dealt to ranges of ids, and those of an id with many rows to ranges of their texts' hashes, as many ranges as the bytes ask for. The first
    row of a range also goes to the range before it, so that no task needs more than its own rows. Rows equal in id and text stay in one range.
    """
    rank = rarity(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = F.when(F.col("doc_id").isNull(), F.lit(HALF)).otherwise(F.lit(0))
    base = plain.withColumn("place", F.coalesce("doc_id", F.lit(LEAST))).withColumn("order", F.xxhash64("text").bitwiseAND(F.lit(HALF - 1)) + gone)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    falling, hashes = range_cuts(base, max(1, min(size >> RANGE_LEAST, max(shuffle_parts(docs.sparkSession), min(size >> RANGE_MOST, RANGES)))))

    @F.pandas_udf("int")
    def bucket(place: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series(range_of(falling, hashes, ~place.to_numpy(np.int64), order.to_numpy(np.int64)).astype(np.int32))

    keyed = base.withColumn("bucket", bucket("place", "order"))
    first = F.min(F.struct(F.bitwise_not("place").alias("falling"), "order"))
    heads = keyed.select("bucket", "place", "order").groupBy("bucket").agg(first.alias("head")).orderBy("bucket").collect()
    # a row for each range, so at most as many as there are cuts
    starts = [(~h["head"]["falling"], h["head"]["order"], heads[k - 1]["bucket"]) for k, h in enumerate(heads)]
    starts = docs.sparkSession.createDataFrame(starts, "place long, order long, bucket int")
    ahead = base.join(F.broadcast(starts), ["place", "order"]).groupBy("bucket").agg(F.min(F.struct("text", "doc_id")).alias("row"))
    both = keyed.select("doc_id", "text", F.lit(0).alias("ahead"), "place", "order", "bucket").unionAll(ahead.select("row.doc_id", "row.text", F.lit(1).alias("ahead"), F.lit(LEAST).alias("place"), F.lit(MOST).alias("order"), "bucket"))
    dealt = both.repartitionById(len(falling) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.desc("place"), "order", "text")
    return dealt.select("doc_id", "text", "ahead").mapInArrow(_compare(rank), ROWS)
