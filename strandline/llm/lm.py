"""Language-model scores of documents with Brown word classes.

Words get classes by exchange clustering: the most frequent ones move one by one to the class that most raises the
likelihood of class bigrams; then, in sweeps over the corpus, every other word of the lexicon moves to the class whose
neighbours are most like its own, until few move. A word's probability is that of its class after the class before, times
that of the word in its class; class transitions back off to class frequencies by Witten-Bell weights.

Words are compared as words, and every count covers the whole training part. What is held in memory is bounded: the
lexicon (the most frequent words, at most lexicon_words of them), the classes and their transitions. Words beyond the lexicon
share one class; their counts are exact too, and joined rather than broadcast. Documents are coded once, as lexicon numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import id_crc, materialize
from strandline.llm.textkernel import chunk_ranges, utf8, word_codes

ADD = 0.1
#: Codes of tokens outside the lexicon.
END, REST = -1, -2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        data, off = utf8(batch.column(0))
        for i, j in chunk_ranges(off):
            codes, words, _ = word_codes(data[off[i] : off[j]], off[i : j + 1] - off[i])
            held.append(pa.table([words, pa.array(np.bincount(codes, minlength=len(words)))], ["w", "n"]))
            size += len(words)
            if size > 1_000_000:
                held = [_merged(held)]
                size = held[0].num_rows
                if size > 500_000:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from _merged(held).to_batches()


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("w").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["w", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n): every distinct lower-cased word and its count."""
    return texts.mapInArrow(_count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


CODED = "rid long, doc_id long, train boolean, codes array<int>, tail array<string>, tail_n array<long>"


def _encode(shared):
    """mapInArrow function: (doc_id, train, text) to the texts' lexicon numbers with END after each, and its words beyond the lexicon with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(shared.value.to_pylist())}
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, off = utf8(batch.column(2))
            for i, j in chunk_ranges(off):
                codes, words, at = word_codes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                known = np.fromiter((number.get(w, REST) for w in words.to_pylist()), np.int32, len(words))
                doc = np.repeat(np.arange(j - i), np.diff(at))
                tail = np.flatnonzero(known[codes] == REST)
                key, n = np.unique(doc[tail] * max(len(words), 1) + codes[tail], return_counts=True)
                place = pa.array(np.searchsorted(key // max(len(words), 1), np.arange(j - i + 1)).astype(np.int32))
                flat = np.insert(known[codes], at[1:], END).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(j - i)), *(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.ListArray.from_arrays(pa.array((at + np.arange(j - i + 1)).astype(np.int32)), pa.array(flat)),
                        pa.ListArray.from_arrays(place, words.take(pa.array(key % max(len(words), 1)))), pa.ListArray.from_arrays(place, pa.array(n)),
                    ],
                    [x.split()[0] for x in CODED.split(", ")],
                )
                rid += j - i

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy()


def _count_pairs(m: int):
    """Bigram counts among the first m words, with index m for the end and m + 1 for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 2) ** 2, np.int64)
        for batch in batches:
            codes = _flat(batch.column(0))
            w = np.where(codes == END, m, np.where((codes < 0) | (codes >= m), m + 1, codes)).astype(np.int64)
            if len(w):
                total += np.bincount(np.concatenate([[m], w[:-1]]) * (m + 2) + w, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    return run


def exchange_classes(pairs: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Classes of m words from their bigram counts (m + 2 square: the last two are fixed classes of their own).

    Words start in `classes` classes by frequency rank; a word moves if another class gives a higher likelihood.
    """
    size = len(pairs)
    m, all_ = size - 2, classes + 2
    cls = np.concatenate([np.arange(m) % classes, [classes, classes + 1]])
    b = pairs.astype(float)
    onehot = np.zeros((size, all_))
    onehot[np.arange(size), cls] = 1
    n = onehot.T @ b @ onehot

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            own = cls[w]
            right, left, self_ = np.bincount(cls, b[w], all_), np.bincount(cls, b[:, w], all_), b[w, w]
            right[own] -= self_
            left[own] -= self_
            n[own] -= right
            n[:, own] -= left
            n[own, own] -= self_
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            r, l = right.sum() + self_, left.sum() + self_
            gain_r = f(n + right) - f(n)
            gain_l = f(n + left[:, None]) - f(n)
            d = np.diag(n)
            gain = gain_r.sum(axis=1) - np.diag(gain_r) + gain_l.sum(axis=0) - np.diag(gain_l) + f(d + right + left + self_) - f(d) - (f(rows + r) - f(rows)) - (f(cols + l) - f(cols))
            gain = gain[:classes]
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            cls[w] = best
            n[best] += right
            n[:, best] += left
            n[best, best] += self_
        if not moved:
            break
    return cls[:m]


def _classes_of(codes: np.ndarray, cls: np.ndarray, kinds: int) -> np.ndarray:
    """Classes of codes: -1 where a lexicon word has none yet, kinds - 2 for the end and kinds - 1 for words beyond the lexicon."""
    return np.where(codes == END, kinds - 2, np.where(codes == REST, kinds - 1, cls[np.maximum(codes, 0)] if len(cls) else 0))


def _count_contexts(cls: np.ndarray, fixed: int, kinds: int):
    """Counts (k, n) of class bigrams, and of the classes beside each lexicon word after the first `fixed`: keys (w, side, class) after the bigrams' kinds**2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = np.zeros(kinds * kinds, np.int64)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def out(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

        for batch in batches:
            codes = _flat(batch.column(0))
            if not len(codes):
                continue
            c = _classes_of(codes, cls, kinds).astype(np.int64)
            before = np.concatenate([[kinds - 2], c[:-1]])
            seen = (c >= 0) & (before >= 0)
            between += np.bincount(before[seen] * kinds + c[seen], minlength=len(between))
            mine = codes >= fixed
            left, right = mine & (before >= 0), mine[:-1] & (c[1:] >= 0)
            w = (codes.astype(np.int64) - fixed) * 2 * kinds
            k, n = np.unique(np.concatenate([w[left] + before[left], w[:-1][right] + kinds + c[1:][right]]), return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > 4_000_000:
                k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)
                keys, counts, size = [k], [n], len(k)
                if size > 2_000_000:
                    yield out(k + kinds * kinds, n)
                    keys, counts, size = [], [], 0
        if keys:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            yield out(k + kinds * kinds, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64))
        some = np.flatnonzero(between)
        yield out(some, between[some])

    return run


def best_classes(contexts: np.ndarray, between: np.ndarray, classes: int) -> np.ndarray:
    """For words with counts contexts[w, side, class] the class that raises the likelihood of the class bigrams `between` most, to first order."""
    n = between + ADD
    after, before = np.log(n / n.sum(axis=1, keepdims=True)), np.log(n / n.sum(axis=0, keepdims=True))
    return (contexts[:, 0] @ before + contexts[:, 1] @ after.T)[:, :classes].argmax(axis=1)


def _move(between: np.ndarray, kinds: int, classes: int):
    """From context counts (k, n), all of a word in one partition, to the words' best classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        k, n = (np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64) for c in (0, 1))
        k = k - kinds * kinds
        order = np.argsort(k // (2 * kinds), kind="stable")
        k, n = k[order], n[order]
        words, at = np.unique(k // (2 * kinds), return_inverse=True)
        best = np.zeros(len(words), np.int64)
        for lo in range(0, len(words), 4096):
            i, j = np.searchsorted(at, [lo, lo + 4096])
            size = min(4096, len(words) - lo)
            dense = np.bincount((at[i:j] - lo) * 2 * kinds + k[i:j] % (2 * kinds), n[i:j], size * 2 * kinds).reshape(size, 2, kinds)
            best[lo : lo + size] = best_classes(dense, between, classes)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int64())], ["w", "c"])

    return run


@dataclass
class ClassModel:
    """Counts and classes of the lexicon's words; log10 transitions; log10 of each class's emission total; the training totals."""

    counts: np.ndarray
    cls: np.ndarray
    transition: np.ndarray
    total: np.ndarray
    n: int
    v: int
    ends: int


def _dense(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    rows = df.groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def lexicon(counts: DataFrame, most: int, least_count: int) -> tuple[pa.Array, np.ndarray, int]:
    """Words of least_count or, if more, the lowest count that keeps them at most `most`, by falling count, their counts, and that count."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).toPandas()
    fits = by_count["n"].to_numpy(np.int64)[by_count["words"].cumsum().to_numpy() <= most]
    least = max(int(fits[-1]), least_count) if len(fits) else 1 << 62
    got = counts.where(F.col("n") >= least).select("w", F.col("n").cast("long").alias("n")).toArrow().sort_by([("n", "descending"), ("w", "ascending")])
    return got["w"].combine_chunks().cast(pa.string()), got["n"].to_numpy(), least


def fit(coded: DataFrame, own: np.ndarray, whole: tuple[int, int], ends: int, classes: int = 60, top: int = 1000, sweeps: int = 2, settled: float = 0.02) -> ClassModel:
    """The model of training codes whose lexicon words have counts `own`; `whole` has the number of all words and of distinct ones.

    The `top` most frequent words are exchanged one by one; each sweep then moves all others, till less than a share `settled` of them moves.
    """
    kinds = classes + 2
    m = min(top, len(own))
    pairs = _dense(coded.mapInArrow(_count_pairs(m), "k long, n long"), (m + 2) ** 2).reshape(m + 2, m + 2)
    cls = np.full(len(own), -1, np.int64)
    cls[:m] = exchange_classes(pairs, classes)
    trans = None
    for sweep in range(sweeps + 1):
        last = sweep == sweeps or m == len(own)
        near = coded.mapInArrow(_count_contexts(cls, len(own) if last else m, kinds), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        near = near if last else materialize(near, "lm-contexts")
        trans = _dense(near.where(F.col("k") < kinds * kinds), kinds * kinds).reshape(kinds, kinds).astype(float)
        if last:
            break
        moved = near.where(F.col("k") >= kinds * kinds).repartition(F.expr(f"(k - {kinds * kinds}) div {2 * kinds}")).mapInArrow(_move(trans, kinds, classes), "w long, c long").toPandas()
        new = cls.copy()
        new[m:] = np.maximum(new[m:], 0)
        new[m + moved["w"].to_numpy(np.int64)] = moved["c"].to_numpy(np.int64)
        sweep_moves = float((new != cls).sum())
        cls = new
        if sweep_moves < settled * (len(own) - m):
            m = len(own)
    # each task's first transition starts at an end, as every document's does
    out, into, follow = trans.sum(axis=1, keepdims=True), trans.sum(axis=0), (trans > 0).sum(axis=1, keepdims=True)
    base = (into + ADD) / (into.sum() + ADD * kinds)
    keep = out / np.maximum(out + follow, 1)
    transition = np.log10(keep * trans / np.maximum(out, 1) + (1 - keep) * base)
    n_words, n_kinds = whole
    emitted, kept = np.bincount(cls, own, kinds), np.bincount(cls, minlength=kinds)
    emitted[kinds - 1], kept[kinds - 1] = n_words - own.sum(), n_kinds - len(own) + 1
    emitted[kinds - 2], kept[kinds - 2] = ends, 1
    with np.errstate(divide="ignore"):
        total = np.log10(emitted + ADD * kept)
    return ClassModel(own, cls, transition, total, n_words + ends, n_kinds + (ends > 0), ends)


SCORED = "rid long, doc_id long, n_tokens long, n_known long, base double, score double"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = shared.value
        kinds = len(m.total)
        logs = np.log10(m.counts + ADD) if len(m.counts) else np.zeros(1)
        bottom = np.log10(m.n + ADD * (m.v + 1))
        end_log = np.log10(m.ends + ADD)
        for batch in batches:
            codes, at = _flat(batch.column(2)), batch.column(2).offsets.to_numpy()
            at = at - at[0]
            if not len(codes):
                continue
            c = _classes_of(codes, m.cls, kinds)
            before = np.concatenate([[kinds - 2], c[:-1]])
            found, last = codes >= 0, codes == END
            own = np.where(found, logs[np.maximum(codes, 0)], np.where(last, end_log, 0.0))
            base = np.add.reduceat(own - bottom, at[:-1])
            score = np.add.reduceat(m.transition[before, c] + np.where(last, 0.0, own - m.total[c]), at[:-1])
            known = np.add.reduceat((found | (last & (m.ends > 0))).astype(np.int64), at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in (np.diff(at).astype(np.int64), known, base, score))], [x.split()[0] for x in SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame, folds: int = 10, lexicon_words: int = 1 << 18, least_count: int = 3, **sizes: int) -> DataFrame:
    """Scores of every row of documents(doc_id, text, ...), learnt from ids whose crc32 is not 0 modulo folds.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (smoothed unigrams) and score (the class
    model), both log10 of the text's probability. Null texts count as empty: the end token alone. Repeated rows score
    alike; extra columns are ignored. Without training rows both models know no word. Words met less than least_count times
    share the class of those beyond the lexicon, at every size: they tell how likely new words are.
    """
    held = F.pmod(id_crc(), F.lit(folds)) == 0
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held).alias("train"), F.col("text").cast("string").alias("text"))
    counts = materialize(word_counts(frame.where("train").select("text")), "lm-words")
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    whole = int(totals[0] or 0), int(totals[1])
    words, own, least = lexicon(counts, lexicon_words, least_count)
    context = docs.sparkSession.sparkContext
    coded = materialize(frame.mapInArrow(_encode(context.broadcast(words)), CODED), "lm-codes")
    train = coded.where("train").select("codes")
    model = fit(train, own, whole, train.count(), **sizes)
    scored = coded.select("rid", "doc_id", "codes").mapInArrow(_score(context.broadcast(model)), SCORED)
    tail = coded.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", F.col("t.tail").alias("w"), F.col("t.tail_n").alias("k"))
    rare = counts.where(F.col("n") < least)
    sums = tail.join(rare, "w", "left").groupBy("rid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("seen"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("logs"))
    out = scored.join(sums, "rid", "left").na.fill(0, ["seen"]).na.fill(0.0, ["logs"])
    # the bottom of the base and the emission total of the class are in the sums of the first pass already
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs")).alias("base_score"), (F.col("score") + F.col("logs")).alias("score"),
    )
