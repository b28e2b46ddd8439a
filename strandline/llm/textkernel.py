"""Vectorised text kernels over Arrow string buffers, used inside mapInArrow tasks.

All work on UTF-8 bytes of many documents at once; a chunk holds whole documents and about
CHUNK_BYTES of text, so that temporaries stay small whatever the batch size is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240917))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SHINGLE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)
_SIZE = _rng.integers(1, 1 << 63, 1, dtype=np.uint64) * _U(2) + _U(1)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
STEPPED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunk_ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes (a longer document alone) and at most `most` documents."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + most)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (one more at the end); space tells the bytes between words."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    if len(data):
        before[0] = False
        before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, the same for equal bytes (A-Z as a-z if fold).

    Spans are mixed in 8 bytes at a time, and long ones by a cryptographic hash. Equal hashes only suggest equal bytes: what has to
    be exact compares words (word_codes).
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _SIZE)
    if not len(size):
        return out
    raw = np.concatenate([_FOLD[data] if fold else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.uint64, raw, 0, (1,))
    todo, k = np.flatnonzero((size > 0) & (size <= STEPPED)), 0
    while len(todo):
        left = size[todo] - k
        out[todo] = mix(out[todo] ^ (eight[starts[todo] + k] & _HEAD[np.minimum(left, 8)]))
        todo, k = todo[left > 8], k + 8
    for i in np.flatnonzero(size > STEPPED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all documents, lower-cased if fold, and each document's first word (one more at the end)."""
    starts, ends, at = word_spans(data, offsets)
    folded = (_FOLD[data] if fold else data)[~_SPACE[data]]
    place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(folded)), at


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """A number for each lower-cased word, equal for equal words only; the words by number; and each document's first word."""
    words, at = words_of(data, offsets)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, at


def shingle_codes(codes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A number for each of the documents' k-word shingles (the whole sequence if shorter), equal for equal ones only, and where each document's begin."""
    n = np.diff(at)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(at[:-1] - begin[:-1], counts) + np.arange(int(begin[-1]))
    padded = np.concatenate([codes, np.full(k, -1, codes.dtype)]).astype(np.int32)
    grams = padded[first[:, None] + np.arange(k)]
    short = np.flatnonzero((n > 0) & (n < k))
    grams[begin[short]] = np.where(np.arange(k) < n[short, None], grams[begin[short]], -1)
    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * k), len(grams), [None, pa.py_buffer(np.ascontiguousarray(grams))])
    return rows.dictionary_encode().indices.to_numpy(), begin


def sequence_digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit digests of the documents' lower-cased word sequences, as two 64-bit columns."""
    starts, _, at = word_spans(data, offsets)
    keep = ~_SPACE[data]
    later = np.ones(len(starts), bool)
    later[at[:-1][np.diff(at) > 0]] = False
    gap = starts[later] - 1
    text = _FOLD[data]
    text[gap] = 0x20
    keep[gap] = True
    place = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
    raw = memoryview(text[keep])
    joined = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(place, place[1:]))
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and each document's first word (one more at the end)."""
    starts, ends, at = word_spans(data, offsets)
    return span_hashes(data, starts, ends), at


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles (its whole sequence if shorter), and where each document's begin."""
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < k))
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begin[-1]), np.uint64)
    if len(words) >= k:
        m = len(words) - k + 1
        h = words[:m] * _SHINGLE[0]
        for j in range(1, k):
            h += words[j : m + j] * _SHINGLE[j]
        keep = np.zeros(m, bool)
        for_doc = np.flatnonzero(n >= k)
        edge = np.zeros(m + 1, np.int32)
        np.add.at(edge, at[for_doc], 1)
        np.add.at(edge, at[for_doc + 1] - k + 1, -1)
        keep = np.cumsum(edge[:-1]) > 0
        place = np.ones(len(out), bool)
        place[begin[short]] = False
        out[place] = mix(h[keep])
    for d in short:
        w = words[at[d] : at[d + 1]]
        out[begin[d]] = mix(np.array([int((w * _SHINGLE[: len(w)]).sum()) & (2**64 - 1)], np.uint64) + _SHINGLE[10 + len(w)])[0]
    return out, begin


def random_odds(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
