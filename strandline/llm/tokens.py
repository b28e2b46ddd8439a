"""Byte-level BPE ids of whole Arrow text columns.

Text is cut at the file's added tokens and into pre-tokens with array operations over code points, every pre-token
is looked up by its bytes in a bounded per-worker lexicon, and only pre-tokens not met before are merged by the library,
all those of a chunk in one call.
The ids equal those of the tokenizer file read by `tokenizers` with add_special_tokens=False.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa

from strandline.llm.textkernel import chunk_ranges, utf8

#: Unicode White_Space, as published.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def classes() -> np.ndarray:
    """The pattern's class of each code point; UNKNOWN for those that this Unicode version does not assign."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pre_tokens(cp: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Sorted start positions of the pre-tokens of documents that begin at doc_at in the code points cp.

    The published rule, each match as long as it can be: 's, 't, 're, 've, 'm, 'll, 'd; letters, numbers or other marks, each with
    one blank before them; white space, without its last character where something else follows.
    """
    n = len(cp)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)
    head[doc_at] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~head[1:n]) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~head[quote + 1]]
    for q in quote.tolist():
        a = chr(cp[q + 1])
        b = chr(cp[q + 2]) if q + 2 < n and not head[q + 2] else ""
        size = 2 if a in "stmd" else 3 if a + b in ("re", "ve", "ll") else 0
        if size:
            start[q + 1] = False
            if q + size < n:
                start[q + size] = True
    return np.flatnonzero(start)


class Lexicon:
    """Ids of pre-tokens by their bytes, for at most `most` pre-tokens at a time; merging is the library's."""

    def __init__(self, path: str, most: int = 400_000):
        import tiktoken

        file = json.load(open(path, encoding="utf-8"))
        values, vocabulary = byte_values(), file["model"]["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        ranks = {bytes(values[c] for c in t): i for t, i in vocabulary.items() if all(c in values for c in t) and t.encode() not in self.added}
        encoding = partial(tiktoken.Encoding, "piece", mergeable_ranks=ranks, special_tokens={})
        self.bpe, self.alone = encoding(pat_str=r"[^\x00]+|\x00"), encoding(pat_str=r"[\s\S]+")
        self.path, self.most, self.zero = path, most, ranks[b"\0"]
        self.clear()

    def clear(self) -> None:
        self.entry: dict[bytes, int] = {piece: k for k, piece in enumerate(self.added)}
        self.ids = np.zeros(4 * self.most, np.uint32)
        self.ids[: len(self.added)] = list(self.added.values())
        self.at = np.arange(self.most + len(self.added) + 1)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pre-tokens in turn, and how many each has: one text with zero bytes between them, or one by one if any holds a zero byte."""
        text = b"\0".join(pieces)
        if text.count(b"\0") >= len(pieces):
            each = [self.alone.encode_ordinary(p.decode()) for p in pieces]
            return np.array([x for ids in each for x in ids], np.uint32), np.array([len(ids) for ids in each])
        ids = self.bpe.encode_to_numpy(text.decode())
        between = ids == self.zero
        return ids[~between], np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1

    def entries(self, pieces: np.ndarray) -> np.ndarray:
        """The entry of each of some distinct pre-tokens, new ones merged first."""
        found = np.fromiter(map(self.entry.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(self.entry) + len(new) > self.most:
            self.most = max(self.most, len(pieces) + len(self.added))
            self.clear()
            found = np.fromiter(map(self.entry.get, pieces, repeat(-1)), np.int64, len(pieces))
            new = np.flatnonzero(found < 0)
        if len(new):
            n, fresh = len(self.entry), pieces[new].tolist()
            ids, sizes = self.merged(fresh)
            end = int(self.at[n])
            if end + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
            self.ids[end : end + len(ids)] = ids
            found[new] = np.arange(n, n + len(new))
            self.at[n + 1 : n + 1 + len(new)] = end + np.cumsum(sizes)
            self.entry.update(zip(fresh, range(n, n + len(new)), strict=True))
        return found

    def added_spans(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Byte spans of added tokens, each inside one document."""
        out = []
        for content in self.added:
            p = raw.find(content)
            while p >= 0:
                if p + len(content) <= offsets[np.searchsorted(offsets, p, "right")]:
                    out.append((p, p + len(content)))
                p = raw.find(content, p + 1)
        return sorted(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in turn, and each document's first id (one more at the end)."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        doc_at = np.searchsorted(lead, offsets)
        if (classes()[cp] == UNKNOWN).any():
            ids = [e.ids for e in library(self.path).encode_batch([raw[offsets[d] : offsets[d + 1]].decode() for d in range(n_docs)], add_special_tokens=False)]
            return np.array([x for one in ids for x in one], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        spans = np.searchsorted(lead, np.array(self.added_spans(raw, offsets), np.int64).reshape(-1, 2))
        start = pre_tokens(cp, np.unique(np.concatenate([doc_at, spans.ravel()])))
        if len(spans):
            within = np.searchsorted(spans[:, 0], start, "left") - 1
            start = start[(within < 0) | (start >= spans[np.maximum(within, 0), 1])]
        a = lead[start]
        places = np.append(a, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        entry = self.entries(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        n = self.at[entry + 1] - self.at[entry]
        end = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[entry] - (end - n), n) + np.arange(int(end[-1]))]
        return flat, np.concatenate([[0], end])[np.searchsorted(start, doc_at)]


@lru_cache(2)
def library(path: str):
    """The tokenizer file read by its library."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def lexicon(path: str) -> Lexicon:
    """The worker's lexicon of a tokenizer file."""
    return Lexicon(path)


def encode_column(column: pa.Array, path: str):
    """Yield (first row, end row, ids, starts) for chunks of whole documents."""
    data, off = utf8(column)
    lex = lexicon(path)
    for i, j in chunk_ranges(off):
        ids, at = lex.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, ids, at
