"""Personal data spans by weak supervision.

Candidate spans (e-mail, IP, card, phone) come from exact and loose patterns. Labelers of three sorts (pattern,
gazetteer, context) vote on each: for, against or abstaining. Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability for a kind and the probability of every pattern; a
logistic span classifier is then trained on those probabilities with the votes and the span's shape. Only
counts of patterns reach the driver, and there are a bounded number of them.

Exact-pattern spans are always kept; the classifier adds loose ones that overlap none of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.llm.textkernel import chunk_ranges, utf8

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("exact", "shape", "gazetteer", "context", "edge")
SHAPES = 24

# Gazetteers.
TLDS = frozenset("com org net edu gov mil int info biz io ai co us uk de fr es it nl be ch at pl pt se no fi dk ie eu ru cn jp kr in br mx ca au nz za test example".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "270", "271", "2720", "34", "37", "6011", "65", "35", "36", "38", "30")
FOR = {
    "email": frozenset("email e-mail mail contact write correo courriel kontakt reach send at to from".split()),
    "ip": frozenset("ip host server address addr login client node from gateway dns ping".split()),
    "card": frozenset("card credit debit visa mastercard amex payment pay tarjeta carte karte account".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone whatsapp sms".split()),
}
AGAINST = {
    "email": frozenset("git ssh package npm".split()),
    "ip": frozenset("version v ver release section chapter build oid revision".split()),
    "card": frozenset("isbn order tracking serial sku hash id part".split()),
    "phone": frozenset("isbn order tracking serial sku version id part".split()),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?")
_SPOKEN = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_WORD = re.compile(r"\w[\w-]*")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    out, p, q = [], 0, t.find("@")
    while q >= 0:
        s = q
        while s > p and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, q + 1) if s < q else None
        if m:
            out.append((s, m.end()))
            p = m.end()
        q = t.find("@", max(p, q + 1))
    return out


def ips(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(t):
        parts = m.group().split(".")
        at, starts = m.start(), []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((starts[i], starts[i + 3] + len(four[3])))
            i += 4
    return out


def cards(t: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of 12 to 19 digits that pass Luhn, and those that fail."""
    good, bad = [], []
    for m in _CARD.finditer(t):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19:
            (good if luhn(digits) else bad).append(m.span())
    return good, bad


def phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def loose(t: str, bad_cards: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Candidates (kind, start, end) beyond the exact patterns."""
    out = [(2, s, e) for s, e in bad_cards]
    if "at]" in t or "at)" in t or "AT]" in t or "AT)" in t or "at ]" in t or "at )" in t:
        for m in _AT.finditer(t):
            s = m.start()
            while s > max(0, m.start() - 64) and t[s - 1] in _LOCAL:
                s -= 1
            d = _SPOKEN.match(t, m.end())
            if s < m.start() and d:
                out.append((0, s, d.end()))
    out += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(t)]
    if t.count(":") >= 4:
        out += [(1, *m.span()) for m in _IP6.finditer(t)]
    return out


def votes(t: str, kind: int, s: int, e: int, exact: bool) -> int:
    """The labelers' votes on a span, 0 against, 1 abstaining, 2 for, as base-3 digits."""
    name, span = KINDS[kind], t[s:e]
    digits = re.sub(r"\D", "", span)
    if kind == 0:
        shape = 2 if span.count("@") == 1 and e - s <= 254 else 1
        gaz = 2 if re.split(r"[^A-Za-z]+", span.rstrip("-"))[-1].lower() in TLDS else 0
    elif kind == 1:
        parts = span.split(".")
        shape = 2 if ":" not in span and any(len(p) > 1 for p in parts) else 1
        gaz = 0 if parts[0] in ("0", "00", "000") or all(len(p) == 1 for p in parts) else 2
    elif kind == 2:
        shape = 2 if re.fullmatch(r"(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{15,16}", span) else 1
        gaz = 2 if digits.startswith(CARD_PREFIXES) else 0
    else:
        shape = 2 if re.search(r"\d{3}[ .-]\d{4}$", span) else 1
        gaz = 2 if 10 <= len(digits) <= 13 else 0 if len(digits) < 8 else 1
    before = {w.lower() for w in _WORD.findall(t[max(0, s - 32) : s])[-4:]}
    context = 2 if before & FOR[name] else 0 if before & AGAINST[name] else 1
    left, right = t[s - 1 : s] if s else "", t[e : e + 1]
    edge = 0 if left.isalnum() or right.isalnum() or left in ("-", "=", "/") and left else 2
    code = 0
    for v in (2 if exact else 0, shape, gaz, context, edge):
        code = 3 * code + v
    return code


def shape_code(t: str, kind: int, s: int, e: int) -> int:
    """A coarse shape of the span, below SHAPES: length, separators, and whether it holds letters."""
    span = t[s:e]
    return min((e - s) // 8, 5) * 4 + 2 * any(c in " -()" for c in span) + any(c.isalpha() for c in span)


Found = tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]


class Taken:
    """What spans (start, kind, end) in order of start cover, as separate stretches, so that a question is one bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in spans:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)
        return k < len(self.starts) and self.starts[k] < e


def find(t: str, at: bool = True, plus: bool = True, digits: bool = True) -> Found:
    """Exact spans (start, kind, end) in order, and candidates (kind, start, end, code), loose ones only where they overlap no exact span; the flags say what the text may hold."""
    good, bad = cards(t) if digits else ([], [])
    exact = [(s, 0, e) for s, e in (emails(t) if at else [])]
    if digits:
        exact += [(s, 1, e) for s, e in ips(t)] + [(s, 2, e) for s, e in good]
    if plus:
        exact += [(s, 3, e) for s, e in phones(t)]
    exact.sort()
    taken = Taken(exact)
    cand = [(k, s, e, True) for s, k, e in exact] + [(k, s, e, False) for k, s, e in loose(t, bad) if not taken.meets(s, e)]
    return exact, [(k, s, e, (votes(t, k, s, e, x) * SHAPES + shape_code(t, k, s, e)) * 4 + k) for k, s, e, x in cand]


def scan(column: pa.Array) -> Iterator[Found]:
    """Findings of every text; texts without the bytes that any pattern needs are passed over."""
    data, off = utf8(column)
    texts = column
    for i, j in chunk_ranges(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]

        def holds(mask: np.ndarray, o=o) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[o])

        at, plus, colon = holds(part == 64), holds(part == 43), holds(part == 58)
        digits, bracket = holds((part >= 48) & (part <= 57)), holds((part == 91) | (part == 40))
        for k in range(j - i):
            if at[k] or plus[k] or digits[k] >= 4 or bracket[k] or colon[k] >= 4:
                yield find(texts[i + k].as_py() or "", bool(at[k]), bool(plus[k]), bool(digits[k] >= 4))
            else:
                yield [], []


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in batches:
        for _, cand in scan(batch.column(0)):
            for *_, code in cand:
                counts[code] = counts.get(code, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["code", "n"])


def _digits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, rest = codes % 4, codes // 4
    shape, v = rest % SHAPES, rest // SHAPES
    out = np.zeros((len(codes), len(LABELERS)), np.int64)
    for k in reversed(range(len(LABELERS))):
        out[:, k] = v % 3
        v = v // 3
    return kind, shape, out


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM for a two-class model in which labelers vote independently given the class.

    Returns each vote pattern's probability of class 1 and P(vote | class) by labeler. The start is a weighted
    majority, so that class 1 is the one that labelers vote for.
    """
    p = 1 / (1 + np.exp(-(v - 1).sum(axis=1).astype(float)))
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        logs = np.tile([np.log(1 - prior), np.log(prior)], (len(v), 1))
        for k in range(v.shape[1]):
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                table[k, c] = np.bincount(v[:, k], w, 3) + (0.5, 0.5, 1.0) if c else np.bincount(v[:, k], w, 3) + (1.0, 0.5, 0.5)
                table[k, c] /= table[k, c].sum()
                logs[:, c] += np.log(table[k, c][v[:, k]])
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return p, table


def fit(docs: DataFrame, cut: float = 0.5) -> dict[int, bool]:
    """Which candidate codes the trained span classifier accepts."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    if not rows:
        return {}
    codes, n = np.array([r["code"] for r in rows]), np.array([r["n"] for r in rows], float)
    kind, shape, v = _digits(codes)
    target = np.zeros(len(codes))
    for k in range(len(KINDS)):
        own = kind == k
        if own.any():
            target[own] = reliabilities(v[own], n[own])[0]
    x = np.zeros((len(codes), 4 + 4 * 3 * len(LABELERS) + 4 * SHAPES))
    here = np.arange(len(codes))
    x[here, kind] = 1
    for k in range(len(LABELERS)):
        x[here, 4 + (kind * len(LABELERS) + k) * 3 + v[:, k]] = 1
    x[here, 4 + 12 * len(LABELERS) + kind * SHAPES + shape] = 1
    w, weight = np.zeros(x.shape[1]), n / n.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (weight * (target - p)) - 0.1 * w)
    accept = x @ w > np.log(cut / (1 - cut))
    return {int(c): bool(a) for c, a in zip(codes, accept, strict=True)}


def accepted(found: Found, model: dict[int, bool]) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) in order: the exact ones, and accepted candidates that overlap no span before them."""
    exact, cand = found
    spans, taken, end = list(exact), Taken(exact), 0
    for k, s, e, code in sorted(cand, key=lambda c: (c[1], c[0], -c[2])):
        if model.get(code) and s >= end and not taken.meets(s, e):
            spans.append((s, k, e))
            end = e
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_text string, spans string"


def _report(model: dict[int, bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(scan(batch.column(1)))
            counts = [pa.array([sum(x[1] == k for x in exact) for exact, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([joined(x[0]) for x in found], pa.string()), pa.array([joined(accepted(x, model)) for x in found], pa.string())], [c.split()[0] for c in ROWS.split(", ")])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of exact spans by kind, their digest, and all spans, one row per row of documents(doc_id, text, ...).

    Positions are code points, ends exclusive. Null texts count as empty: no spans, and the digest of the empty string.
    Repeated rows give repeated results; extra columns are ignored.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = frame.mapInArrow(_report(fit(frame)), ROWS)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_text").cast("binary"), 256).alias("base_sha256"), "spans")


def _mask(model: dict[int, bool], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            out = []
            for k, found in enumerate(scan(texts)):
                t = texts[k].as_py()
                if found[0] or found[1]:
                    parts, at = [], 0
                    for s, kind, e in accepted(found, model):
                        if s >= at:
                            parts += [t[at:s], f"<{KINDS[kind].upper()}>"]
                        at = max(at, e)
                    t = "".join([*parts, t[at:]])
                out.append(t)
            columns = list(batch.columns)
            columns[column] = pa.array(out, batch.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def mask(docs: DataFrame, refresh_n_chars: bool = True) -> DataFrame:
    """docs with every span in text replaced by <KIND>, other columns as they are, n_chars renewed where there is one. Null texts stay null."""
    model = fit(docs)
    out = docs.mapInArrow(_mask(model, docs.columns.index("text")), docs.schema)
    if refresh_n_chars and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
