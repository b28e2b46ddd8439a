"""Phrase collocations: frequent phrases of two to five words, scored by their weakest cut.

Words that are frequent in their language get numbers, and texts are written once as rows of numbers, with zeros where a piece
ends or a rare word stands. Phrases then grow a word at a time (Apriori): a phrase can only be frequent if its beginning and its end are, so
with the frequent phrases of one length in a double-array trie that every task holds, all places of a text advance through it at once, one level
after the other, and the next length's candidates are the places that are accepted and whose next place is, too. Each task counts
its candidates and the shuffle sums what tasks have. At last the trie of all frequent phrases is run over the numbers, the places' accepting
states are counted by bincount, and the shards' counts are summed: these are the counts of the result. Words and phrases go to tasks in blocks
of a bounded size, one pass each; cuts, scores and ranks are joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, shuffle_parts
from strandline.llm.textkernel import _FOLD, chunk_ranges, utf8, word_spans

#: Bytes that end a piece, and those between words.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = PIECE.copy()
BETWEEN[[0x20, 0x09]] = True
CHUNK = 1 << 22
#: Most words that a block of the vocabulary holds, and most phrases that a trie is built for: what a task and the driver hold.
WORDS = 1 << 19
PHRASES = 1 << 19
#: Distinct entries that a task gathers before it hands them on.
HELD = 1 << 19
KEYS = 1 << 22


def words_in(data: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of documents by number, each document's first word (one more at the end), and whether the word before is in the same piece."""
    starts, ends, at = word_spans(data, off, BETWEEN)
    place = np.concatenate([[0], np.cumsum(ends - starts)])
    folded = _FOLD[data][~BETWEEN[data]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(folded))
    pieces = np.cumsum(PIECE[data], dtype=np.int64)[starts]
    joined = np.diff(pieces, prepend=-1) == 0
    joined[at[:-1][at[:-1] < len(starts)]] = False
    return words.dictionary_encode(), at, joined


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """Of rows (lang, text, ...): the chunk's rows, its languages, its words' distinct (language, word) numbers, words, firsts and joints."""
    data, off = utf8(batch.column(1))
    for i, j in chunk_ranges(off, CHUNK):
        words, at, joined = words_in(data[off[i] : off[j]], off[i : j + 1] - off[i])
        langs = batch.column(0).slice(i, j - i).dictionary_encode()
        pair = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(at)) * max(len(words.dictionary), 1) + words.indices.to_numpy()
        yield i, j, langs.dictionary, pair, words, at, joined


def _named(pairs: np.ndarray, langs: pa.Array, words: pa.DictionaryArray) -> tuple[list[str], list[str]]:
    n = max(len(words.dictionary), 1)
    return langs.take(pa.array(pairs // n)).to_pylist(), words.dictionary.take(pa.array(pairs % n)).to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of a task's words; a row without a word has the sum of a language."""
    held: dict[tuple[str, str | None], int] = {}

    def rows() -> pa.RecordBatch:
        langs, words = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "f"])

    for batch in batches:
        for _, _, langs, pair, words, *_ in _chunks(batch):
            pairs, counts = np.unique(pair, return_counts=True)
            for lang, word, f in zip(*_named(pairs, langs, words), counts.tolist(), strict=True):
                held[lang, word] = held.get((lang, word), 0) + f
                held[lang, None] = held.get((lang, None), 0) + f
            if len(held) > HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def _to_numbers(block, first: bool, last: bool):
    """Adds the numbers of a block's words (lang -> word -> number); the last block's pass gives chunks of numbers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block.value
        for batch in batches:
            for i, j, langs, pair, words, at, joined in _chunks(batch):
                pairs, place = np.unique(pair, return_inverse=True)
                own = np.array([numbers.get(lang, {}).get(word, 0) for lang, word in zip(*_named(pairs, langs, words), strict=True)], np.int32)
                codes = own[place] if len(own) else np.zeros(0, np.int32)
                if not first:
                    codes = codes + np.frombuffer(b"".join(batch.column(2).slice(i, j - i).to_pylist()), np.int32)
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array([_tight(codes, joined).tobytes()], pa.binary())], ["codes"])
                else:
                    each = [codes[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), pa.array(each, pa.binary())], ["lang", "text", "codes"])

    return run


def _tight(codes: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Numbers of words that have a numbered neighbour in their piece, and a zero after each row of them."""
    link = np.zeros(len(codes) + 1, bool)
    link[1:-1] = joined[1:] & (codes[1:] > 0) & (codes[:-1] > 0)
    keep = link[1:] | link[:-1]
    last = keep & ~link[1:]
    out = np.zeros(int(keep.sum() + last.sum()), np.int32)
    places = np.cumsum(keep.astype(np.int64) + np.concatenate([[0], last[:-1]]))[keep] - 1 if len(codes) else np.zeros(0, np.int64)
    out[places] = codes[keep]
    return out


@dataclass
class Trie:
    """A double array: the child of state s by number c is base[s] + c if check[base[s] + c] is s; the states of single words are their numbers.

    phrases holds a row for each state's phrase (padded by zeros), row its index by state (-1: none), own whether the phrase was asked for.
    """

    base: np.ndarray
    check: np.ndarray
    row: np.ndarray
    phrases: np.ndarray
    own: np.ndarray

    def advance(self, codes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3, ... up to `length` words: the places where a phrase of the trie of so many words begins, and their states."""
        at = np.flatnonzero(codes)
        state = codes[at].astype(np.int64)
        for k in range(1, length):
            inside = at + k < len(codes)
            at, state = at[inside], state[inside]
            to = self.base[state] + codes[at + k].astype(np.int64)
            good = (self.check[to] == state) & (codes[at + k] > 0)
            at, state = at[good], to[good]
            yield at, state


class Slots:
    """The places of a double array: which are taken, and where a row of children fits."""

    def __init__(self, first: int, size: int):
        self.used = np.zeros(size, bool)
        self.used[:first] = True
        self.first = first

    def need(self, size: int) -> None:
        if size > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(max(size - len(self.used), len(self.used)), bool)])

    def any(self, n: int) -> np.ndarray:
        """The first n free places."""
        self.need(int(np.count_nonzero(self.used)) + n)
        spots = np.flatnonzero(~self.used)[:n]
        self.used[spots] = True
        return spots

    def fit(self, codes: np.ndarray, begin: int) -> int:
        """The first base, its first child not before `begin`, at which all places of rising codes are free."""
        wide, most = 32, max(32, (1 << 18) // len(codes))
        while True:
            self.need(begin + int(codes[-1]) + wide)
            spots = begin + np.flatnonzero(~self.used[begin : begin + wide])
            bases = spots - int(codes[0])
            good = np.flatnonzero(~self.used[bases[:, None] + codes].any(axis=1))
            if len(good):
                base = int(bases[good[0]])
                self.used[base + codes] = True
                return base
            begin, wide = begin + wide, min(2 * wide, most)


def build_trie(phrases: np.ndarray, words: int) -> Trie:
    """A trie of rows of numbers from 1 to `words`, padded by zeros to one width; beginnings of phrases are states as well.

    Level by level, states of many children first: each takes the first base where all of them find free places, and looks on from where the last one
    stands. States of one child then fill the free places in their order.
    """
    width = phrases.shape[1]
    slots = Slots(words + 1, 2 * words + phrases.size + 64)
    state = phrases[:, 0].astype(np.int64)
    rows, states, owns, parents_of, bases_of = [], [], [], [], []
    for k in range(1, width):
        live = np.flatnonzero(phrases[:, k] > 0)
        keys, one, place = np.unique(state[live] << 32 | phrases[live, k], return_index=True, return_inverse=True)
        code = keys & 0xFFFFFFFF
        parents, begin, count = np.unique(keys >> 32, return_index=True, return_counts=True)
        base = np.zeros(len(parents), np.int64)
        many = np.flatnonzero(count > 1)
        at = slots.first
        for g in many[np.argsort(-count[many], kind="stable")].tolist():
            base[g] = slots.fit(code[begin[g] : begin[g] + count[g]], at)
            at = int(base[g] + code[begin[g]])
        single = np.flatnonzero(count == 1)
        base[single] = slots.any(len(single)) - code[begin[single]]
        to = np.repeat(base, count) + code
        parents_of.append(keys >> 32)
        bases_of.append((parents, base))
        states.append(to)
        rows.append(np.where(np.arange(width) <= k, phrases[live[one]], 0))
        asked = np.zeros(len(keys), bool)
        asked[place[(phrases[live, k + 1] == 0) if k + 1 < width else np.ones(len(live), bool)]] = True
        owns.append(asked)
        state[live] = to[place]
    slots.need(max([0, *(int(b.max(initial=0)) for _, b in bases_of)]) + words + 1)
    base, check, row = (np.full(len(slots.used), x, np.int32) for x in (0, 0, -1))
    for (parents, bases), from_, to in zip(bases_of, parents_of, states, strict=True):
        base[parents], check[to] = bases, from_
    flat = np.concatenate([np.zeros(0, np.int64), *states])
    row[flat] = np.arange(len(flat))
    return Trie(base, check, row, np.concatenate([np.zeros((0, width), np.int32), *rows]), np.concatenate([np.zeros(0, bool), *owns]))


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts' sums."""
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    return flat[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for raw in batch.column(0):
        yield np.frombuffer(raw.as_buffer(), np.int32) if len(raw.as_buffer()) else np.zeros(0, np.int32)


def _candidates(trie, length: int, both: bool):
    """(key, f) of a task's candidates of `length` words: the state of all but the last, and the last word. both: the trie has all of their length, so the end is looked at, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["key", "f"])

        for batch in batches:
            for codes in _numbers(batch):
                at = np.flatnonzero(codes)
                state = codes[at].astype(np.int64)
                if length > 2:
                    for at, state in trie.value.advance(codes, length - 1):  # noqa: B007  the last level is what counts
                        pass
                    if len(state):
                        asked = trie.value.own[trie.value.row[state]]
                        at, state = at[asked], state[asked]
                if both:
                    there = np.zeros(len(codes) + 1, bool)
                    there[at] = True
                    good = there[at + 1]
                else:
                    good = at + length - 1 < len(codes)
                at, state = at[good], state[good]
                last = codes[at + length - 1].astype(np.int64)
                key, n = np.unique((state << 32 | last)[last > 0], return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > KEYS:
                    (keys[:], counts[:]) = ([x] for x in _sum(keys, counts))
                    if len(keys[0]) > KEYS // 2:
                        yield rows()
                        keys.clear()
                        counts.clear()
        if keys:
            (keys[:], counts[:]) = ([x] for x in _sum(keys, counts))
            yield rows()

    return run


def _accepted(trie, length: int):
    """(key, f) of a task's places in the trie's own phrases, by state: a bincount of all levels' states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(trie.value.base), np.int64)
        for batch in batches:
            for codes in _numbers(batch):
                for _, state in trie.value.advance(codes, length):
                    if len(state):
                        here = np.bincount(state)
                        counts[: len(here)] += here
        some = np.flatnonzero(counts)
        some = some[trie.value.own[trie.value.row[some]]] if len(some) else some
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["key", "f"])

    return run


def _spelled(trie, candidates: bool):
    """(codes, f) of keys: a state's phrase, and for candidates the word behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, f = batch.column(0).to_numpy(), batch.column(1)
            state, last = (key >> 32, key & 0xFFFFFFFF) if candidates else (key, np.zeros(len(key), np.int64))
            rows = trie.value.phrases[trie.value.row[state]] if trie is not None else state[:, None]
            wide = np.column_stack([rows, last]).astype(np.int32)
            some = wide > 0
            at = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(wide[some])), f], ["codes", "f"])

    return run


def _blocks(phrases: DataFrame, width: int, words: int) -> Iterator[tuple[object, bool]]:
    """Broadcast tries of phrases(codes, ...), at most about PHRASES each, and whether one holds them all."""
    n = max(1, -(-phrases.count() // PHRASES))
    for b in range(n):
        own = phrases.where(F.pmod(F.xxhash64("codes"), F.lit(n)) == b) if n > 1 else phrases
        got = own.select("codes").toArrow()["codes"].combine_chunks()
        size = np.diff(got.offsets.to_numpy())
        rows = np.zeros((len(size), width), np.int32)
        rows[np.arange(width) < size[:, None]] = got.flatten().to_numpy()
        yield phrases.sparkSession.sparkContext.broadcast(build_trie(rows, words)), n == 1


def _grown(coded: DataFrame, tries: list, length: int, least: int) -> DataFrame:
    """Frequent phrases (codes, f) of one length; tries are of those one word shorter."""
    out = None
    for trie, both in tries:
        summed = coded.mapInArrow(_candidates(trie, length, both), "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        found = summed.mapInArrow(_spelled(trie, True), "codes array<int>, f long")
        out = found if out is None else out.unionAll(found)
    return materialize(out, f"phrases-{length}")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, f) and phrases (codes, f) of at least `least` occurrences, and sums (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = materialize(counted.where((F.col("f") >= least) | F.col("word").isNull()), "word-counts")
    sums = counted.where("word is null").select("lang", F.col("f").alias("n"))
    # numbers from 1 by falling count: ranges, each row's place in its range, and a row a range with what came before
    dealt = counted.where("word is not null").repartitionByRange(shuffle_parts(spark), F.desc("f"), "lang", "word").sortWithinPartitions(F.desc("f"), "lang", "word")
    ranges = materialize(dealt.withColumn("_m", F.monotonically_increasing_id()).select("*", F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_nth")), "word-ranges")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("_part").count().select("_part", before.alias("_start"))
    vocabulary = materialize(ranges.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_nth") + 1).cast("int").alias("id"), "lang", "word", "f"), "vocabulary")
    words = vocabulary.count()
    none = vocabulary.where("false").select(F.array("id").alias("codes"), "f")
    if not words:
        return vocabulary, none, sums
    coded = texts
    for low in range(0, words, WORDS):
        numbers: dict[str, dict[str, int]] = {}
        for i, lang, word in zip(*(c.to_pylist() for c in vocabulary.where(F.col("id").between(low + 1, low + WORDS)).select("id", "lang", "word").toArrow().columns), strict=True):
            numbers.setdefault(lang, {})[word] = i
        last = low + WORDS >= words
        coded = materialize(coded.mapInArrow(_to_numbers(spark.sparkContext.broadcast(numbers), low == 0, last), "codes binary" if last else "lang string, text string, codes binary"), "numbers")
    found = [_grown(coded, [(None, True)], 2, least)]
    for length in range(3, longest + 1):
        if found[-1].isEmpty():
            break
        found.append(_grown(coded, list(_blocks(found[-1], length - 1, words)), length, least))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    counts = none
    for trie, _ in _blocks(every, longest, words):
        summed = coded.mapInArrow(_accepted(trie, longest), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
        counts = counts.unionAll(summed.mapInArrow(_spelled(trie, False), "codes array<int>, f long"))
    return vocabulary, materialize(counts, "phrases"), sums


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """Each language's `most` best phrases of documents(lang, text, ...): lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased (A-Z) and cut into pieces and words by ASCII marks and white space; phrases lie in a piece, and all their
    occurrences count, overlapping ones too. Cut after k words into parts of l and r occurrences, a phrase of a among n words scores floor(1000 a n / (l r)); its lowest
    cut counts, the first one of equals. Phrases in a longer one that occurs as often are left out. Ranks go by falling score, falling a, then the phrase's
    bytes. A null text is empty, a null language `und`; repeated rows count as often as they are there; without frequent words there are
    no rows; extra columns are ignored. Scores are exact while 1000 a n and l r have at most 38 digits.
    """
    vocabulary, phrases, sums = frequent_phrases(docs, least, longest)
    every = phrases.unionAll(vocabulary.select(F.array("id").alias("codes"), "f"))
    size = F.size("codes")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.slice("codes", 1, size - 1), F.slice("codes", 2, size - 1))).alias("codes"), F.col("f").alias("g"))
    kept = phrases.join(inner.groupBy("codes").agg(F.max("g").alias("g")), "codes", "left").where("g is null or 100 * g < 100 * f").select("codes", F.col("f").alias("a"))
    spelled = kept.select("codes", "a", F.posexplode("codes").alias("pos", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    named = spelled.groupBy("codes").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = named.join(sums, "lang")
    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("*", F.slice("codes", F.lit(1), F.col("k")).alias("_left"), F.slice("codes", F.col("k") + 1, size - F.col("k")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(every.select(F.col("codes").alias(side), F.col("f").alias(name)), side)
    score = F.expr("(CAST(1000 * a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    worst = cuts.withColumn("_s", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min("_s").alias("_s"))
    rows = worst.select("lang", "phrase", "a", "n", "_s.l", "_s.r", "_s.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within parts of a language, so that no task ranks all of a language's phrases
    parts = Window.partitionBy("lang", "_part").orderBy(*order)
    best = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
