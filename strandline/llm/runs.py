"""Runs (maximal periodic stretches) of the word sequences of documents.

Suffixes are grouped as in the first phase of Baier's suffix sorter, which leaves the Lyndon array: at each place the length of the
longest Lyndon word that starts there. By the runs theorem every run has a root that is such a word under an order of
the words or under its reverse, so the phase runs under both. Each root is extended by longest common extensions to both sides, and the
stretches of at least two periods are the runs.

Groups are only made where a run of the asked length can lie. In a run of period q and length of at least 2q and 12, six words
in a row that begin q or more before its end come again q later, and such sixes cover the run. So places that no repeated six of their
document covers are in no run, and the rest falls into stretches that hold their runs whole.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.textkernel import chunk_ranges, mix, random_odds, utf8, words_of

#: Shortest runs that are reported, in words; sixes are half of it.
LEAST = 12
CHUNK = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ODD = random_odds(LEAST // 2 + 2, 41)


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of codes (0 parts texts and has none; a longer text is larger than its beginning).

    Groups hold the places whose suffixes are known to share a beginning, the group's context. The highest group that is left is final:
    its context is the Lyndon word of its places. Each of its places is then appended to the nearest lower place before it; the places of a
    group that take k contexts move to a new group right above their old one, with a context longer by k.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    first = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
    ends = np.append(first[1:], n)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(np.arange(len(first), dtype=np.int32), ends - first)
    group = array("i", rank.tobytes())
    before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
    found = array("i", bytes(4 * n))
    parted = n > 0 and sorted_codes[0] == 0
    members = [order[a:b].tolist() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    context = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1] if members else []
    done = bytearray(len(members))
    top, lowest = len(members) - 1, 0 if parted else -1
    while top != lowest:
        size = context[top]
        done[top] = 1
        taken: dict[int, int] = {}
        for i in members[top]:
            if group[i] != top:
                continue
            found[i] = size
            p = before[i]
            if p >= 0 and done[group[p]]:
                way = i
                while p >= 0 and done[group[p]]:
                    way, p = p, before[p]
                j = i
                while j != way:
                    before[j], j = p, before[j]
                before[way] = p
            if p >= 0:
                taken[p] = taken.get(p, 0) + 1
        members[top] = None
        if taken:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in taken.items():
                g = group[p]
                if g == lowest and parted:
                    continue
                at = moves.get((k, g))
                if at is None:
                    moves[k, g] = [p]
                else:
                    at.append(p)
            for (k, g), places in sorted(moves.items(), reverse=True) if len(moves) > 1 else moves.items():
                new = len(members)
                members.append(places)
                context.append(context[g] + k * size)
                done.append(0)
                up = above[g]
                below.append(g)
                above.append(up)
                above[g] = new
                below[up] = new
                for p in places:
                    group[p] = new
        top = below[top]
    return np.frombuffer(found, np.int32).astype(np.int64)


class Extensions:
    """Longest common extensions of places at a distance, by sums of words times powers modulo 2**64: never too short, and checked by the words where they count."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.n = letters, len(letters)
        self.powers = np.full(self.n + 1, _ODD[0])
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(letters.astype(np.uint64) * _ODD[1]) * self.powers[:-1])])

    def alike(self, a: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size words from a on and from a + p on look equal."""
        return (self.sums[a + size] - self.sums[a]) * self.powers[p] == self.sums[a + p + size] - self.sums[a + p]

    def after(self, a: np.ndarray, p: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), self.n - a - p
        while (todo := np.flatnonzero(low < high)).size:
            size = (low[todo] + high[todo] + 1) // 2
            good = self.alike(a[todo], p[todo], size)
            low[todo] = np.where(good, size, low[todo])
            high[todo] = np.where(good, high[todo], size - 1)
        return low

    def ahead(self, a: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same for the words before a and before a + p."""
        low, high = np.zeros(len(a), np.int64), a.copy()
        while (todo := np.flatnonzero(low < high)).size:
            size = (low[todo] + high[todo] + 1) // 2
            good = self.alike(a[todo] - size, p[todo], size)
            low[todo] = np.where(good, size, low[todo])
            high[todo] = np.where(good, high[todo], size - 1)
        return low

    def exact(self, period: int, root: int) -> tuple[int, int, int]:
        """Start, end and period of the stretch around root, word by word: for sums that agree by chance."""
        x, end = self.letters, root + period
        while end < self.n and x[end] == x[end - period]:
            end += 1
        start = root
        while start > 0 and x[start - 1] == x[start - 1 + period]:
            start -= 1
        return start, end, period


def runs_of(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of at least `least` words, by start and period; codes are positive, and 0 parts texts."""
    n = len(codes)
    top = int(codes.max(initial=0))
    split = codes == 0
    letters = codes.astype(np.int64)
    letters[split] = top + 1 + np.arange(int(split.sum()))
    roots = np.concatenate([lyndon_lengths(codes), lyndon_lengths(np.where(split, 0, top + 1 - codes))])
    at = np.tile(np.arange(n), 2)
    room = n - at - roots
    at, roots, room = (x[roots > 0] for x in (at, roots, room))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    both = Extensions(letters)
    # of the period that a run has beside its root, one side brings half
    half = (roots + 1) // 2
    size = np.minimum(half, room)
    good = (size == half) & both.alike(at, roots, size)
    size = np.minimum(half, at)
    good |= (size == half) & both.alike(at - size, roots, size)
    at, roots = at[good], roots[good]
    start, end = at - both.ahead(at, roots), at + roots + both.after(at, roots)
    enough = end - start >= np.maximum(2 * roots, least)
    start, end, roots, at = start[enough], end[enough], roots[enough], at[enough]
    order = np.lexsort((end, roots, start))
    start, end, roots, at = (x[order] for x in (start, end, roots, at))
    new = np.any(np.diff(np.stack([start, roots, end]), prepend=-1) != 0, axis=0)
    one = np.flatnonzero(new)
    size = end[one] - start[one] - roots[one]
    flat = np.repeat(start[one] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    wrong = np.add.reduceat(letters[flat] != letters[flat + np.repeat(roots[one], size)], np.cumsum(size) - size) > 0 if len(size) else np.zeros(0, bool)
    again = [both.exact(int(roots[k]), int(at[k])) for k in np.flatnonzero(wrong[np.cumsum(new) - 1]).tolist()] if wrong.any() else []
    start, end, roots = (np.append(x[one[~wrong]], y).astype(np.int64) for x, y in zip((start, end, roots), np.array(again, np.int64).reshape(-1, 3).T, strict=True))
    found = np.unique(np.stack([start, roots, end], axis=1)[end - start >= np.maximum(2 * roots, least)], axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def stretches(codes: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that repeated rows of least / 2 words of the same document cover, if they have `least` words."""
    k, n = least // 2, len(codes)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    m = n - k + 1
    inside = doc[:m] == doc[k - 1 :]
    letters = mix(codes.astype(np.uint64) * _ODD[1])
    grams = doc[:m].astype(np.uint64) * _ODD[0]
    for j in range(k):
        grams += letters[j : m + j] * _ODD[j + 2]
    grams = mix(grams)[inside]
    place = np.flatnonzero(inside)
    ordered = np.sort(grams)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return none, none
    spot = np.searchsorted(again, grams)
    place = place[again[np.minimum(spot, len(again) - 1)] == grams]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
    ends = covered.copy()
    ends[:-1] &= ~covered[1:] | (doc[1:] != doc[:-1])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= least
    return start[long], end[long]


def word_runs(codes: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of all documents, whose words begin at `at`; places count over all documents."""
    start, end = stretches(codes, at, least)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    # stretches side by side, with a zero after each
    size = end - start + 1
    begin = np.cumsum(size) - size
    source = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    last = begin + size - 1
    source[last] -= 1
    _, small = np.unique(codes[source], return_inverse=True)
    small = (small + 1).astype(np.int32)
    small[last] = 0
    s, e, p = runs_of(small, least)
    shift = source[s] - s
    return s + shift, e + shift, p


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of (doc_id, text) with a periodic end where a hash of the id says so; see periodic_ends."""
    for batch in batches:
        numbers = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in batch.column(0).to_pylist()], np.int64)
        some = np.flatnonzero(numbers % 10 == 0)
        column = batch.column(1)
        data, off = utf8(column.take(pa.array(some)))
        words, at = words_of(data, off, fold=False)
        n = np.diff(at)
        picks = []
        for k in np.flatnonzero(n).tolist():
            g, size = int(numbers[some[k]]) // 10, int(n[k])
            a = g % size
            p = 1 + (size - a) // (3 + g % 8)
            picks.append(at[k] + np.concatenate([np.arange(a), a + np.arange(size - a) % p]))
        if picks:
            mask = np.zeros(batch.num_rows, bool)
            mask[some[n > 0]] = True
            places = np.concatenate([[0], np.cumsum(n[n > 0])]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(places), words.take(pa.array(np.concatenate(picks)))), " ")
            column = pc.replace_with_mask(column.cast(pa.string()), pa.array(mask), joined)
        yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "text"])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column(1))
        for i, j in chunk_ranges(off, CHUNK):
            words, at = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i], fold=False)
            codes = words.dictionary_encode().indices.to_numpy()
            start, end, period = word_runs(codes, at)
            gone = np.zeros(len(codes) + 1, np.int32)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            keep = np.cumsum(gone[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[at].astype(np.int32)
            left = words if keep.all() else words.filter(pa.array(keep))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), left), " ")
            doc = np.searchsorted(at, start, "right") - 1
            fields = [pa.array(x.astype(np.int64)) for x in (start - at[doc], end - start, period)]
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def _found(docs: DataFrame, *steps) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row of documents(doc_id, text, ...).

    A run is a stretch of words of least period q and at least max(12, 2q) words that no neighbour extends; `runs` lists them by start, then
    period (start, length, period in words). `collapsed` joins by spaces the words that no run holds behind its first q words. Words are told
    apart by their bytes, as they are written. Null and empty texts have no words and no runs; repeated rows fare alike; null ids stay;
    extra columns are ignored. A document is handled whole in one task, with others in chunks of 2 MB, and rows are never shuffled.
    """
    return _found(docs, _find)


def periodic_ends(docs: DataFrame) -> DataFrame:
    """What periodic_runs finds in documents of which about every tenth gets a periodic end.

    With h the crc32 of the id as text (a null id: the empty text) and g = h // 10, the n words of a document with h % 10 = 0 become periodic from word a = g % n on:
    word i becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    return _found(docs, _plant, _find)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without runs) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
