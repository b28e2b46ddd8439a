"""Language identification by hyperdimensional letter n-gram profiles.

Each letter has a random bipolar vector. An n-gram's vector binds its letters, each rolled by its place; a
document's vector bundles the vectors of its n-grams, and a language's prototype bundles those of its
documents. A document gets the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import id_crc
from strandline.llm.textkernel import chunk_ranges, utf8
from strandline.llm.tokens import LETTER, classes

#: Bytes of text in a chunk, and n-gram kinds whose vectors are held at a time.
CHUNK, KINDS = 1 << 19, 8192


@lru_cache(1)
def letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for all else."""
    out = np.where(classes() == LETTER, np.arange(0x110000), 0)
    for i in np.flatnonzero(out).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out.astype(np.int32)


@lru_cache(1 << 17)
def letter_vector(letter: int, dim: int, seed: int) -> np.ndarray:
    """A letter's own random signs; what is no letter has a vector too, that of 0."""
    return np.random.Generator(np.random.PCG64([seed, letter])).integers(0, 2, dim, dtype=np.int8) * 2 - 1


def bundles(data: np.ndarray, offsets: np.ndarray, dim: int, seed: int, edges: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each document, and whether it has a letter. Without an edge, the first or last letter there only stands beside the next."""
    n = len(offsets) - 1
    total, some = np.zeros((n, dim), np.float32), np.zeros(n, bool)
    if not len(data):
        return total, some
    s = letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    alphabet, s = np.unique(s, return_inverse=True)
    if alphabet[0] != 0:
        alphabet, s = np.append(0, alphabet), s + 1
    size = len(alphabet)
    at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    # each document's letters between zeros
    wide = np.zeros(len(s) + 2 * n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    wide[np.arange(len(s)) + 2 * owner + 1] = s
    doc = np.repeat(np.arange(n), np.diff(at) + 2)
    mid = np.flatnonzero(wide[1:-1]) + 1
    mid = mid[(edges[0] | (mid != 1)) & (edges[1] | (mid != len(wide) - 2))]
    kinds, gram = np.unique((wide[mid - 1] * size + wide[mid]) * size + wide[mid + 1], return_inverse=True)
    doc = doc[mid]
    some[doc] = True
    base = np.stack([letter_vector(int(x), dim, seed) for x in alphabet]).astype(np.float32)
    first, second = np.roll(base, 2, 1), np.roll(base, 1, 1)
    order = np.argsort(gram, kind="stable") if len(kinds) > KINDS else None
    for lo in range(0, len(kinds), KINDS):
        part = kinds[lo : lo + KINDS]
        if order is None:
            g, d = gram, doc
        else:
            own = order[np.searchsorted(gram[order], lo) : np.searchsorted(gram[order], lo + len(part))]
            g, d = gram[own] - lo, doc[own]
        counts = np.bincount(d * len(part) + g, minlength=n * len(part)).reshape(n, len(part)).astype(np.float32)
        total += counts @ (first[part // (size * size)] * second[part // size % size] * base[part % size])
    return total, some


def _code_point(text: np.ndarray, at: int, step: int = 1) -> int:
    """The first place from `at` on, or back, where a code point begins or the text ends."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at += step
    return min(max(at, 0), len(text))


def document_bundles(data: np.ndarray, offsets: np.ndarray, dim: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of documents with their vectors and whether they have a letter.

    A document longer than a chunk is taken in pieces that share a letter with each neighbour: vectors add up, so what is held does not grow with it.
    """
    for i, j in chunk_ranges(offsets, CHUNK, 256):
        text = data[offsets[i] : offsets[j]]
        if len(text) <= CHUNK:
            yield i, j, *bundles(text, offsets[i : j + 1] - offsets[i], dim, seed)
            continue
        total, some = np.zeros((1, dim)), np.zeros(1, bool)
        at = sorted({_code_point(text, c) for c in (*range(0, len(text), CHUNK), len(text))})
        for a, b in zip(at, at[1:], strict=False):
            lo, hi = _code_point(text, a - 1, -1), _code_point(text, b + 1)
            v, letter = bundles(text[lo:hi], np.array([0, hi - lo]), dim, seed, (a == 0, b == len(text)))
            total += v
            some |= letter
        yield i, j, total.astype(np.float32), some


def _profile(dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, off = utf8(batch.column(0))
            lang = np.array(batch.column(1).to_pylist(), object)
            for i, j, v, _ in document_bundles(data, off, dim, seed):
                for x in sorted(set(lang[i:j])):
                    total[x] = total.get(x, 0) + v[lang[i:j] == x].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    return run


def fit_profiles(docs: DataFrame, dim: int = 512, seed: int = 11, rows_per_lang: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from documents (text, lang) with a language.

    At most about rows_per_lang documents of a language are used, chosen by a hash of their text; copies of a text go together.
    What reaches the driver is one vector for each language.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    share = {r["lang"]: min(1.0, rows_per_lang / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], np.zeros((0, dim), np.float32)
    part = F.coalesce(*(F.when(F.col("lang") == x, F.lit(p)) for x, p in share.items() if p < 1), F.lit(1.0)) if any(p < 1 for p in share.values()) else F.lit(1.0)
    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part * 1_000_000) if any(p < 1 for p in share.values()) else known
    sums = chosen.mapInArrow(_profile(dim, seed), "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    names = sorted(share)
    out = np.zeros((len(names), dim))
    for r in sums.collect():
        out[names.index(r["lang"]), r["k"]] = r["x"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return names, (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _predict(names: list[str], prototypes: np.ndarray, dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.num_columns - 1))
            found, score = [], []
            for _, _, v, some in document_bundles(data, off, dim, seed):
                norm = np.linalg.norm(v, axis=1)
                some &= (norm > 0) & bool(names)
                cosine = v @ prototypes.T / np.where(norm > 0, norm, 1)[:, None] if names else np.zeros((len(v), 1))
                best = cosine.argmax(axis=1)
                found += [names[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                score.append(np.where(some, cosine[np.arange(len(v)), best].clip(0, 1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, training: DataFrame, keep: list[str], dim: int = 512, seed: int = 11, rows_per_lang: int = 20_000) -> DataFrame:
    """docs' columns `keep` with lang_pred and score, learnt from training(text, lang).

    The score is the cosine with the chosen prototype, cut to 0..1. Null texts and texts without a letter get
    und and 0, as does everything if no training row has a language. Ties go to the first language by name.
    Long texts are taken in pieces of half a megabyte.
    """
    names, prototypes = fit_profiles(training, dim, seed, rows_per_lang)
    columns = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns.schema.fields[:-1]) + "lang_pred string, score double"
    return columns.mapInArrow(_predict(names, prototypes, dim, seed), schema)


def held_out_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows whose id's crc32 is 0 modulo folds are not learnt from."""
    out = F.pmod(id_crc(), F.lit(folds)) == 0
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", out)
    return identify(frame, frame.where(~F.col("held_out")), ["doc_id", "held_out"])
