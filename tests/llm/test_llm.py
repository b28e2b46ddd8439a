"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import ann, fingerprint, langid, lm, mixing, neardup, packing, pii, quality, tokencount, tokens
from strandline.llm.textkernel import word_spans

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("score", "p", "rate", "component_id", "rank"))])
LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
ODD = [
    (1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (4, "one", "en"), (5, "one two three", "de"), (5, "one two three", "de"), (6, "123 456 !!", None), (None, "no id here at all", "fr"),
    (7, LONG, "en"), (8, LONG + " tail", "en"), (9, "日本語 テスト don't  'tis\n\n x", None), (10, "a" * 300_000, None), (11, "One TWO three", "de"),
]


#: Two words of 1,024 letters that every polynomial hash modulo 2**64 takes for one.
TWINS = ["a", "b"]
for _ in range(10):
    TWINS = [TWINS[0] + TWINS[1], TWINS[1] + TWINS[0]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, x, "s", len(t or ""), 0.5, 0.5, 0.5, 0.5, 0.5) for i, t, x in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(len(x & y) and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    for r in neardup.near_duplicates(docs).collect():
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
        assert r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]]))


def test_near_duplicates_links_of_a_chain(spark):
    base = [f"t{i}" for i in range(84)]
    rows = [(100 - k, " ".join(base[:60] + [f"z{k}_{j}" if j < 2 * k else base[60 + j] for j in range(24)])) for k in range(12)]
    rows += [(k, "\n".join(f"q{k}_{i}" for i in range(30)) + " " + " ".join(base[:20])) for k in range(200, 260)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_long_chains(spark):
    n = 400
    mixed = [int(x) for x in np.random.Generator(np.random.PCG64(1)).permutation(n)]
    rising = [(k, k + 1) for k in range(1, n)]
    falling = [(20_000 - k, 20_000 - k - 1) for k in range(1, n)]
    anyhow = [(40_000 + x, 40_000 + y) for x, y in zip(mixed, mixed[1:])]
    star = [(60_000 + k, 60_000 + n) for k in range(n)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(rising + falling + anyhow + star, "a long, b long")).collect()}
    want = dict.fromkeys(range(1, n + 1), 1) | dict.fromkeys(range(20_000 - n, 20_000), 20_000 - n) | dict.fromkeys(range(40_000, 40_000 + n), 40_000) | dict.fromkeys(range(60_000, 60_001 + n), 60_000)
    assert got == want


def test_words_are_told_apart(spark):
    rows = [(1, " ".join(TWINS[0] for _ in range(5))), (2, " ".join(TWINS[1] for _ in range(5))), (3, TWINS[0]), (4, TWINS[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["n"] for r in lm.word_counts(frame.select("text")).collect()} == {6}
    left, right = pa.array(["p q r s t u v w", TWINS[0], "", "x y"]), pa.array(["P q  r s t u v w", TWINS[1], "", "x\ny"])
    assert neardup.links_of(left, right, 5, 75).tolist() == [True, False, False, True]


def test_sketches_pass_links():
    """Bits of min-max signatures of pairs at similarity 0.75: the bound on differing bits leaves 5.5 deviations of room."""
    rng = np.random.default_rng(4)
    off = []
    for k in range(300):
        h = rng.integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        bits = []
        for own in (h[:600], h[100:]):
            y = own[:, None] * neardup.random_odds(100, k)[None]
            bits.append((neardup.mix(np.stack([y.min(axis=0), y.max(axis=0)], axis=1).ravel()) & np.uint64(1))[: neardup.SKETCH])
        off.append(int((bits[0] != bits[1]).sum()))
    chance = (1 - 500 / 700) / 2
    assert np.mean(off) == pytest.approx(neardup.SKETCH * chance, rel=0.05) and max(off) < neardup.SKETCH * 0.125 + 5.5 * (neardup.SKETCH * 0.125 * 0.875) ** 0.5


def test_near_duplicates_across_blocks_of_a_bucket(spark):
    base = [f"t{i}" for i in range(84)]
    rows = [(100 - k, " ".join(base[:60] + [f"z{k}_{j}" if j < 2 * k else base[60 + j] for j in range(24)])) for k in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=2).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_drifting_texts(spark):
    rows = [(k + 1, " ".join(f"t{i}" for i in range(3 * k, 3 * k + 40))) for k in range(160)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1


def test_near_duplicates_aggregate_crowded_buckets_only(spark, docs, monkeypatch):
    """Members, centres and pivots equal plain loops; what is posted is counted by its keys, and no whole row of it is sorted."""
    plans, steps, write = {}, {}, neardup.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        steps.setdefault(name, write(df, name))
        return steps[name]

    monkeypatch.setattr(neardup, "materialize", kept)
    got = neardup.crowded(kept(neardup.signatures(docs).where("n_shingles > 0").withColumnRenamed("doc_id", "rep"), "near-classes"))
    assert not [k for k, p in plans.items() if "Generate" in p and ("SortAggregate" in p or "SortMergeJoin" in p)]
    buckets = {}
    for r in steps["near-classes"].collect():
        for b in r["bands"]:
            buckets.setdefault(b, []).append((r["rep"], r["n_shingles"], *r["sketch"]))
    buckets = {b: x for b, x in buckets.items() if len(x) > 1}
    rows = got.withColumn("h", F.xxhash64("doc.rep", "bucket")).collect()
    hashes = {(r["bucket"], r["doc"]["rep"]): r["h"] for r in rows}
    want = [(b, d, min(x), min(x, key=lambda m: (hashes[b, m[0]], m))) for b, x in buckets.items() for d in x]
    assert sorted((r["bucket"], tuple(r["doc"]), tuple(r["centre"]), tuple(r["pivot"])) for r in rows) == sorted(want)
    assert len(want) > 0 and steps["near-posted"].count() == len(want)


def test_near_duplicates_odd(odd, empty):
    got = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(odd).collect()}
    assert got[1, 0]["component_id"] == 1 and got[2, 0]["kept"] and got[3, 0]["kept"]
    assert got[8, 59_997]["component_id"] == 7 and not got[8, 59_997]["kept"]
    assert got[11, 1]["component_id"] == 5
    assert got[None, 1]["component_id"] is None and got[None, 1]["kept"]
    assert neardup.near_duplicates(odd).count() == len(ODD)
    assert neardup.near_duplicates(empty).count() == 0


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    texts = [x for _, x, _ in ODD if x and len(x) < 100_000] + ["don't we'll  it's 'tis ''s 're'd", "\n\n  x \n y\t\tz", " 's  's\n's", "naïve café’s ½ ² 𝒳 😀😀", "  ", "a'd'll'veb", "x<|endoftext|>y", "a  <|endoftext|> 's<|endof", "text|><|endoftext|>", *TWINS, "\u0378 <|endoftext|>"]
    got = []
    for i, j, ids, at in tokens.encode_column(pa.array(texts), tokens.default_path()):
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_an_exact_cover(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = packing.pack(docs).toPandas()
    for doc, part in got.groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        part = part.sort_values("start")
        assert part.start.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.9
    small = packing.pack(odd, group_rows=4).toPandas()
    assert len(small[small.start == 0]) == len(ODD)
    assert (small.groupby("sequence_id").length.sum() <= 1024).all()


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing_places_first():
    lengths = np.array([5, 7, 3, 6, 2, 2])
    bins, offsets = packing.first_fit_decreasing(lengths, 10)
    assert bins.tolist() == [2, 0, 0, 1, 1, 1] and offsets.tolist() == [0, 0, 7, 0, 6, 8]


def test_token_counts_round_trip(docs, odd, empty):
    # read once: an unsorted frame, whose rows come in another order at each reading, keeps its ids
    for frame in (docs, odd, docs.repartition(5, F.rand()).orderBy(F.rand())):
        rows = [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]
        want = sorted((str(i), len(e.ids)) for (i, _), e in zip(rows, tokens.library(tokens.default_path()).encode_batch([t for _, t in rows], add_special_tokens=False), strict=True))
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.count_documents(frame).collect()) == want
    assert tokencount.count_documents(empty).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        tokencount.count_documents(docs, width=1).count()


def test_token_files_are_cut_by_bytes(spark, docs, odd, tmp_path):
    for name, frame in (("a", docs), ("b", odd)):
        at = str(tmp_path / name)
        tokencount.write_token_files(frame.coalesce(1), at, run_bytes=4096)
        sizes = [f.stat().st_size for f in (tmp_path / name).glob("kind=1/run=*/part-*")]
        assert len(sizes) == len(list((tmp_path / name).glob("kind=0/run=*/part-*"))) >= (10 if frame is docs else 3)
        texts = [r["text"] or "" for r in frame.collect()]
        longest = max(len(tokens.library(tokens.default_path()).encode(t, add_special_tokens=False).ids) for t in texts)
        assert max(sizes) <= 4096 + 2 * longest + 2
        got = tokencount.separator_scan(tokencount.token_files(spark, at), block_bytes=1000)
        assert got.count() == len(texts) and got.where("not closed").count() == 0
        assert got.agg(F.sum("n_tokens")).first()[0] * 2 + 2 * len(texts) == sum(sizes)
        own = sorted((str(r["doc_id"]) for r in tokencount.file_documents(spark, at).collect()))
        assert own == sorted(str(r["doc_id"]) for r in frame.collect())


def test_token_runs_of_empty_documents_end(spark, tmp_path):
    frame = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1)
    tokencount.write_token_files(frame, str(tmp_path / "e"), run_bytes=1800)
    assert len(list((tmp_path / "e").glob("kind=1/run=*/part-*"))) == 10
    assert sorted((r["doc_id"], r["doc_index"]) for r in tokencount.file_documents(spark, str(tmp_path / "e")).collect()) == [(i, i % 100) for i in range(1000)]


def test_separator_scan_stitches_blocks(spark):
    rng = np.random.default_rng(5)
    ids = rng.choice([0, 1, 2, 3], 4000, p=[0.01, 0.4, 0.3, 0.29]).astype("<u2")
    ids[-3:] = 2
    ends = np.flatnonzero(ids == 0)
    want = [int(x) for x in np.diff(np.concatenate([[-1], ends])) - 1]
    parts = [("f", k * 10, bytearray(ids[k * 640 : (k + 1) * 640].tobytes())) for k in range(7)]
    got = tokencount.separator_scan(spark.createDataFrame(parts, "file string, first_block long, content binary"), block_bytes=128).orderBy("doc_index").toPandas()
    assert got[got.closed].n_tokens.tolist() == want and got.doc_index.tolist() == list(range(len(got)))
    assert got[~got.closed].n_tokens.tolist() == [4000 - 1 - int(ends[-1])]


def test_languages_held_out(docs, odd, empty):
    got = langid.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    rows = {r["doc_id"]: r for r in langid.held_out_languages(odd).collect()}
    assert rows[1]["lang_pred"] == "und" and rows[6]["lang_pred"] == "und" and rows[6]["score"] == 0
    assert langid.held_out_languages(odd).count() == len(ODD)
    assert langid.held_out_languages(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.held_out_languages(unlabelled).collect()} == {"und"}


def test_language_profiles_equal_plain_loops(spark):
    rows = [(1, "Ab, cd é", "x"), (2, "жук abc", "y"), (3, "日本 日", "x"), (4, "abé", None), (5, None, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dim, seed = 64, 3

    def bundle(text):
        out = np.zeros(dim)
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            v = [langid.letter_vector(x, dim, seed).astype(float) for x in (0, *map(ord, word), 0)]
            out += sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:]))
        return out

    names, prototypes = langid.fit_profiles(frame, dim, seed)
    want = np.stack([sum(bundle(t) for _, t, x in rows if x == name) for name in ("x", "y")])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert names == ["x", "y"] and prototypes == pytest.approx(want, abs=1e-6)
    for r in langid.identify(frame, frame, ["doc_id", "text"], dim, seed).collect():
        v = bundle(r["text"])
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            cosine = want @ v / np.linalg.norm(v)
            assert r["lang_pred"] == names[cosine.argmax()] and r["score"] == pytest.approx(max(cosine.max(), 0), abs=1e-6)


def test_language_profiles_of_many_kinds(monkeypatch):
    data = np.frombuffer("the quick brown fox and other long words жук".encode(), np.uint8)
    off = np.array([0, 20, len(data)])
    want = langid.bundles(data, off, 32, 1)[0]
    monkeypatch.setattr(langid, "KINDS", 5)
    assert langid.bundles(data, off, 32, 1)[0] == pytest.approx(want)


def test_language_pieces_add_up(monkeypatch):
    texts = ["Жук ab, 日本語 𝒳é cd!" * 9, "zé" * 40, "..." * 30, "ß", "abc" * 11 + "日"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want, some = langid.bundles(data, off, 32, 1)
    for chunk in (4, 5, 7, 16, 61):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        got = list(langid.document_bundles(data, off, 32, 1))
        assert np.concatenate([g[3] for g in got]).tolist() == some.tolist() == [True, True, False, True, True]
        assert np.concatenate([g[2] for g in got]) == pytest.approx(want)


def test_language_of_a_very_long_text_in_bounded_memory():
    data = np.frombuffer(("the quick brown fox, " * 500_000).encode(), np.uint8)
    tracemalloc.start()
    ((_, _, v, some),) = langid.document_bundles(data, np.array([0, len(data)]), 64, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = langid.bundles(np.frombuffer(b"the quick brown fox, ", np.uint8), np.array([0, 21]), 64, 1)[0]
    assert some[0] and v == pytest.approx(one * 500_000) and peak < 64e6 + len(data)


def test_quality_held_out(spark, docs, labels, odd, empty):
    big, more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(big, more).join(more, "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    good = got.quality == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.9
    assert quality.score_quality(odd, labels).count() == len(ODD)
    assert quality.score_quality(empty, labels.limit(0)).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_personal_data_base_equals_plain_patterns(docs, odd, empty):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def base(t):
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15])

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[1] for x in want) for k in range(4)]
        assert set(pii.joined(want).split(",")) <= set(r["spans"].split(","))
    for t in ("a@b.c@d.e f@g@h.i.j", "1.2.3.4.5.6.7.8 1..2.3.4.5 256.1.1.1.1 999.1.2.3.4.5", "4111 1111 1111 1111-4 4111-1111-1111-1111", "+1 (555) 555-1234 5 +12 +1+2345678901", "x..@-.- é a@b.c.", "5.6.7.8@x.y 12.13.14.15."):
        assert pii.find(t)[0] == base(t), t
    assert pii.personal_data(odd).count() == len(ODD)
    assert pii.personal_data(empty).count() == 0


def test_accepted_spans_equal_pairwise_checks():
    rng = np.random.default_rng(6)
    for _ in range(200):
        spans = sorted((int(s), int(rng.integers(4)), int(s + rng.integers(1, 9))) for s in rng.integers(0, 60, rng.integers(0, 8)))
        cand = [(k, s, e, 0) for s, k, e in spans] + [(int(rng.integers(4)), int(s), int(s + rng.integers(1, 9)), int(rng.integers(2))) for s in rng.integers(0, 60, 8)]
        want = list(spans)
        for k, s, e, code in sorted(cand, key=lambda c: (c[1], c[0], -c[2])):
            if code and all(e <= a or s >= b for a, _, b in want):
                want.append((s, k, e))
        assert pii.accepted((spans, cand), {1: True}) == sorted(want)


def test_many_numbers_in_a_text_end():
    text = " ".join(f"call +1 555 {k:07d} or 555-123-{k % 10000:04d}, card 4111 1111 1111 {k % 10000:04d}" for k in range(20_000))
    exact, cand = pii.find(text)
    assert len(exact) >= 20_000 and len(pii.accepted((exact, cand), {c[3]: True for c in cand})) >= 40_000


def test_reliabilities_equal_plain_loops():
    v, n = np.array([[2, 2, 1], [2, 0, 1], [0, 0, 2], [1, 2, 0], [0, 1, 1]]), np.array([30.0, 7, 40, 3, 11])
    p = [1 / (1 + np.exp(-sum(x - 1 for x in row))) for row in v]
    for _ in range(60):
        prior = (sum(a * b for a, b in zip(n, p)) + 1) / (n.sum() + 2)
        table = {}
        for k in range(3):
            for c in (0, 1):
                w = [a * (b if c else 1 - b) for a, b in zip(n, p)]
                t = [sum(x for x, row in zip(w, v) if row[k] == z) + ((0.5, 0.5, 1.0) if c else (1.0, 0.5, 0.5))[z] for z in range(3)]
                table[k, c] = [x / sum(t) for x in t]
        odds = [np.log(prior / (1 - prior)) + sum(np.log(table[k, 1][row[k]] / table[k, 0][row[k]]) for k in range(3)) for row in v]
        p = [1 / (1 + np.exp(-x)) for x in odds]
    assert pii.reliabilities(v, n)[0] == pytest.approx(p, abs=1e-9)


def test_personal_data_masks(spark):
    text = "é mail bo.b@mail.example.com or call +1 (555) 555-1234 from 10.20.30.40"
    got = pii.mask(spark.createDataFrame([(1, text, 5), (2, None, 0)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert got[0]["text"] == "é mail <EMAIL> or call <PHONE> from <IP>" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] is None


def test_reliabilities_prefer_the_agreeing_labelers():
    v = np.array([[2, 2, 2], [2, 2, 0], [0, 0, 0], [0, 0, 2]])
    p, table = pii.reliabilities(v, np.array([40.0, 10.0, 40.0, 10.0]))
    assert p[0] > 0.9 and p[2] < 0.1 and table[0, 1, 2] > table[2, 1, 2]


def test_fingerprints(docs, odd, empty):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: -x[0])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    seen = {}
    for k, (i, t) in enumerate(rows):
        u, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
        assert seen.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and got[i]["n_chars"] == len(t)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.2 + np.mean([r["near_next"] for r in got.values()])
    assert fingerprint.fingerprints(odd).count() == len(ODD)
    assert fingerprint.fingerprints(empty).count() == 0


def test_hot_ids_are_cut_along_texts(spark, monkeypatch):
    """A third of the rows with one id, copies among them, null ids and the least id: every row has its next, whatever the ranges are."""
    monkeypatch.setattr(fingerprint, "RANGE_LEAST", 4)
    least = -(1 << 63)
    rows = [(7, f"text {i} of the hot id") for i in range(150)] + [(7, "a copy of one row")] * 60 + [(None, f"no id {i}") for i in range(40)] + [(None, None), (least, "least"), (least, "least too")]
    rows += [(i * 3 - 90, f"row {i} " * (i % 5)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    line = sorted(((-r["doc_id"] if r["doc_id"] is not None else -least + 1, r["h"] & ((1 << 62) - 1), r["text"], r["doc_id"]) for r in hashed), key=lambda x: x[:3])
    want = []
    for k, (_, _, t, i) in enumerate(line):
        u, half = line[(k + 1) % len(line)][2], len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    for parts in ("3", "40"):
        monkeypatch.setattr(fingerprint, "shuffle_parts", lambda s, parts=parts: int(parts))
        got = fingerprint.fingerprints(frame).select("doc_id", "edited_sha256", F.spark_partition_id().alias("part")).collect()
        assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)
    assert len({r["part"] for r in got if r["doc_id"] == 7}) > 5 and len({r["part"] for r in got if r["doc_id"] is None}) > 1


def test_window_pairs_equal_counting():
    d = np.random.default_rng(1).integers(97, 105, 500).astype(np.uint8)
    w = fingerprint.window_pairs(d)
    assert [int(x) for x in w] == [sum(c * (c - 1) // 2 for c in Counter(d[i : i + 64].tolist()).values()) for i in range(437)]


def test_nearest_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = e.toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float)
    got = ann.nearest(e, e.where("vec_id % 50 = 0"), list_size=40).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.score.is_monotonic_decreasing
        for r in own.itertuples():
            assert r.score == pytest.approx(s[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12)
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 5
    assert hit / total >= 0.9


def test_nearest_vectors_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [0.0, 3.0]), (None, [1.0, 1.0]), (9, [1e300, 1e300]), (10, [-2.0]), (8, [0.0, 5.0])]
    e = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = ann.nearest(e, e.where("vec_id in (0, 3, 8, 7)")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 9), (0, 8), (7, 10), (8, 9), (8, 0), (8, 1), (8, 2)]
    assert ann.nearest(e.limit(0), e.limit(0)).count() == 0


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(8)
    c = ann.unit(rng.normal(size=(3000, 16)))
    x = ann.unit(rng.normal(size=(200, 16)))
    ids, sims = ann.Graph(c).search(x, 48)
    want = np.argsort(-(x @ c.T), axis=1)[:, :16]
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(ids, want, strict=True)]) > 0.95
    assert (np.diff(sims, axis=1) <= 0).all() and all(len(set(r)) == 48 for r in ids)
    for k in (1, 2, 5):
        ids, _ = ann.Graph(c[:k]).search(x, 48)
        assert ids.shape[1] == k and (np.sort(ids, axis=1) == np.arange(k)).all()
    assert len(ann.balanced_centroids(c, 700)) == pytest.approx(700, abs=30)


def test_language_model_base_and_gain(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_documents(docs).toPandas()
    tokens_of = {r["doc_id"]: [*words(r["text"]), "<end>"] for r in docs.collect()}
    count = Counter()
    for i, w in tokens_of.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for r in got.itertuples():
        w = tokens_of[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert lm.score_documents(odd).count() == len(ODD)
    assert lm.score_documents(empty).count() == 0


def test_language_model_equals_naive_class_model(docs):
    """Classes as found; everything else by plain loops over words."""
    rows = [(r["doc_id"], words(r["text"])) for r in docs.limit(60).collect()]
    frame = docs.sparkSession.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    small = dict(classes=6, top=40, sweeps=2)
    got = {r["doc_id"]: r for r in lm.score_documents(frame, lexicon_words=300, least_count=1, **small).collect()}
    train = [(i, w) for i, w in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(x for _, w in train for x in w)
    kept = {}
    for n in sorted(set(count.values()), reverse=True):
        more = [w for w, c in count.items() if c == n]
        if len(kept) + len(more) > 300:
            break
        kept |= dict.fromkeys(more)
    names = sorted(kept, key=lambda w: (-count[w], w.encode()))
    own = np.array([count[w] for w in names])
    number = {w: k for k, w in enumerate(names)}
    code = [[*(number.get(x, lm.REST) for x in w), lm.END] for _, w in train]
    coded = docs.sparkSession.createDataFrame([(c,) for c in code], "codes array<int>")
    m = lm.fit(coded, own, (sum(count.values()), len(count)), len(train), **small)
    kinds = 8
    of = lambda x: kinds - 2 if x == lm.END else kinds - 1 if x == lm.REST else int(m.cls[x])
    trans, emitted, members = np.zeros((kinds, kinds)), np.zeros(kinds), [set() for _ in range(kinds)]
    for (_, w), c in zip(train, code, strict=True):
        before = kinds - 2
        for name, x in zip([*w, "</s>"], c, strict=True):
            trans[before, of(x)] += 1
            emitted[of(x)] += 1
            members[of(x)].add(name)
            before = of(x)
    members[kinds - 1].add("<new>")
    base = (trans.sum(axis=0) + 0.1) / (trans.sum() + 0.1 * kinds)
    for i, w in rows:
        before, total = kinds - 2, 0.0
        for x, name in zip([*(number.get(x, lm.REST) for x in w), lm.END], [*w, None], strict=True):
            c = of(x)
            keep = trans[before].sum() / max(trans[before].sum() + (trans[before] > 0).sum(), 1)
            total += np.log10(keep * trans[before, c] / max(trans[before].sum(), 1) + (1 - keep) * base[c])
            if name is not None:
                total += np.log10((count[name] + 0.1) / (emitted[c] + 0.1 * len(members[c])))
            before = c
        assert got[i]["score"] == pytest.approx(total, rel=1e-9)
    assert (10**m.transition).sum(axis=1) == pytest.approx(np.ones(kinds), abs=1e-9)


def test_sweeps_put_words_of_like_use_together():
    between = np.array([[1, 90, 5, 4], [90, 1, 5, 4], [5, 5, 0, 0], [4, 4, 0, 0]], float)
    contexts = np.array([[[9, 0, 0, 0], [8, 0, 0, 0]], [[0, 9, 0, 0], [0, 8, 0, 0]]], float)
    assert lm.best_classes(contexts, between, 2).tolist() == [1, 0]


def test_exchange_groups_words_of_like_use():
    pairs = np.zeros((8, 8), int)
    for a in (0, 2, 4):
        for b in (1, 3, 5):
            pairs[a, b] = pairs[b, a] = 20
    cls = lm.exchange_classes(pairs, 2)
    assert len(set(cls[[0, 2, 4]])) == 1 and len(set(cls[[1, 3, 5]])) == 1 and cls[0] != cls[1]


def test_mixing_meets_targets(spark, odd, empty, labels):
    docs, more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = mixing.mixture(docs, more).toPandas()
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    total = (got.rate * got.n_tokens).to_numpy() @ p
    assert total / total.sum() == pytest.approx(np.array(mixing.TARGETS), abs=0.02)
    assert (got.rate >= 0).all() and p.sum(axis=1) == pytest.approx(np.ones(len(p)))
    assert mixing.mixture(odd, labels).count() == len(ODD)
    assert mixing.mixture(empty, labels).count() == 0
    assert mixing.mix(empty, labels).count() == 0


@pytest.mark.parametrize("rate", [0.04, 0.09, 0.93, 1.07])
def test_copies_keep_the_expected_total(spark, rate):
    got = spark.range(40_000).select("id", F.lit(rate).alias("rate")).select(mixing.copies("rate", "id").alias("n")).agg(F.avg("n")).first()[0]
    assert got == pytest.approx(rate, abs=0.006)


def dense_rates(p, tokens_, target, scale, pull, most):
    """Plain accelerated projected gradient, restarted where it turns, on all rates at once; scale is the unit of each domain's error."""
    a = (p * tokens_[:, None] / scale).T
    c = pull * tokens_ / target.sum()
    w = 1 / np.sqrt(tokens_)
    step = 1 / (np.linalg.norm(a * w, 2) ** 2 + pull / target.sum())
    r = y = np.ones(len(p))
    t = 1.0
    for _ in range(30_000):
        new = np.clip(y - step * w * w * (a.T @ (a @ y - target / scale) + c * (y - 1)), 0, most)
        if (y - new) @ ((new - r) / (w * w)) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / after * (new - r), new, after
    return r


MIXES = [(5, 94, 1), (2, 97, 1), (5, 90, 5), (1, 1, 98), (90, 8, 2), (98, 1, 1), (33, 33, 34), (50, 49, 1), (20, 79, 1), (10, 80, 10), (1, 98, 1), (40, 20, 40), (0, 99, 1), (60, 0, 40), (100, 0, 0), (9, 90, 1)]


@pytest.mark.parametrize("sharp", [20, 3])
@pytest.mark.parametrize("mix", MIXES)
def test_rates_of_all_mixes_equal_dense_ones(mix, sharp):
    rng = np.random.default_rng(5)
    sizes = [12 * m for m in mix]
    p = np.concatenate([rng.dirichlet([sharp if d == k else 0.5 for d in range(3)], n) for k, n in enumerate(sizes)])
    tokens_ = rng.integers(20, 80, len(p)).astype(float)
    rates = mixing.fit_multipliers(lambda m: mixing.sums_of(p, tokens_, m, 4.0), tokens_ @ p, np.array(mixing.TARGETS), 0.001, 4.0, 2e-3)
    assert rates.status in ("met", "scarce", "skewed")
    got = (rates.of(p) * tokens_) @ p
    assert got == pytest.approx(rates.reached)
    scale = np.maximum(rates.target, 1e-3 * rates.target.sum())

    def worth(r, scale):
        return (((r * tokens_) @ p / scale - rates.target / scale) ** 2).sum() + 0.001 / rates.target.sum() * (tokens_ * (r - 1) ** 2).sum()

    dense = dense_rates(p, tokens_, rates.target, scale, 0.001, 4.0)
    want = (dense * tokens_) @ p
    scarce = want < rates.target * 0.998
    scarce[rates.target.argmax()] = False
    if scarce.any() and (want > rates.target + 2e-3 * scale).any():
        scale = np.where(scarce, 30 * scale, scale)
        dense = dense_rates(p, tokens_, rates.target, scale, 0.001, 4.0)
        want = (dense * tokens_) @ p
    assert worth(rates.of(p), scale) <= 1.002 * worth(dense, scale) + 1e-7
    assert (np.abs(got - want) <= 0.006 * np.maximum(want, rates.target)).all()
    if rates.status != "skewed":
        assert (got <= rates.target * 1.0051).all() and got.max() >= rates.target.max() * 0.9949


@pytest.mark.parametrize("sizes", [(6_000, 6_000, 3_000), (9_000, 900, 9), (3_000, 9_000, 600), (500, 9_400, 100)])
def test_copies_meet_targets_on_skewed_corpora(spark, sizes):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.dirichlet([20 if d == k else 0.5 for d in range(3)], n) for k, n in enumerate(sizes)])
    tokens_ = rng.integers(20, 80, len(p))
    frame = spark.createDataFrame([(i, x.tobytes(), int(n)) for i, (x, n) in enumerate(zip(p, tokens_, strict=True))], "doc_id long, p binary, n_tokens long")
    rates = mixing.fit_rates(frame.select("p", "n_tokens"), mixing.TARGETS)
    rated = frame.mapInArrow(mixing._rated(rates), "doc_id long, n_tokens long, p_good double, p_poor double, p_toxic double, rate double")
    got = rated.withColumn("copies", mixing.copies("rate", "doc_id")).toPandas().sort_values("doc_id")
    assert rates.reached == pytest.approx((got.rate * got.n_tokens).to_numpy() @ p) and got.rate.max() <= rates.most
    total = (got.copies * got.n_tokens).to_numpy() @ p
    if sizes[0] > 1_000:
        assert total[0] == pytest.approx(float(tokens_ @ p[:, 0]), rel=0.02)
    if min(sizes) > 10:
        assert rates.status == "met" and total / total.sum() == pytest.approx(np.array(mixing.TARGETS), abs=0.012)


def test_mixing_without_labels_or_tokens(spark, docs, labels):
    got = mixing.mixture(docs, labels.where("false")).toPandas()
    assert (got.rate == 1).all() and (got.copies == 1).all()
    bare = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert mixing.mixture(bare, labels).count() == 2


def test_mixing_counts_the_tokens_that_packing_packs(docs, labels):
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.mixture(docs, labels).collect()}
    packed = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs).collect()}
    assert {i: n + 1 for i, n in got.items()} == packed


class Counted:
    """Counts what is asked of something."""

    def __init__(self, inner):
        self.inner, self.asked = inner, 0

    def __getattr__(self, name):
        self.asked += 1
        return getattr(self.inner, name)


@pytest.mark.parametrize("between", [" ", "\0", " \0\0", "\0x "])
def test_new_pre_tokens_are_merged_in_bulk(between):
    """The library is asked once for a text's new pre-tokens, not once for each, and ids are its own, with zero bytes too."""
    lex = tokens.Lexicon(tokens.default_path(), most=3000)
    lex.bpe = Counted(lex.bpe)
    for part in range(3):
        texts = [between.join(f"Wort{chr(97 + i % 26)}ü{i * 7919 % 10007}'s" for i in range(900 * part, 900 * (part + 1))), "", None, "\0", f"zuletzt{part}"]
        data, off = tokens.utf8(pa.array(texts))
        ids, at = lex.encode(data, off)
        want = [e.ids for e in tokens.library(tokens.default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert lex.bpe.asked <= 3 and len(lex.entry) <= 3000


def test_mixing_cuts_a_text_into_words_once(monkeypatch):
    """Bare words and statistics come from one cut into words; both are those of the plain way."""
    texts = ["", "(a) -b- c. --- . .. ... a-b 'tis", " \n", "x", "...", "Ein (Wort), noch ein Wort. Ein ü-Wort!\n!!", None, "(a)" * 40 + " b"]
    data, off = tokens.utf8(pa.array(texts))
    stats = quality.statistics(data, off)
    cuts = []
    for module in (mixing, quality):
        monkeypatch.setattr(module, "word_spans", lambda *a: cuts.append(1) or word_spans(*a))
    ids, at, got = mixing.features(data, off)
    assert len(cuts) == 1 and got.tobytes() == stats.tobytes()
    marks = {chr(c) for c in np.flatnonzero(mixing._MARK)}
    for i, text in enumerate(texts):
        bare = [w[(w[0] in marks and len(w.encode()) > 1) : len(w) - (w[-1] in marks and len(w.encode()) > 2)].encode() for w in words(text)]
        raw, ends = np.frombuffer(b"".join(bare), np.uint8), np.cumsum([0, *map(len, bare)])
        assert ids[at[i] : at[i + 1]].tolist() == sorted({int(h >> np.uint64(40)) % mixing.HASHED for h in mixing.span_hashes(raw, ends[:-1], ends[1:])})


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_keeps_one_of_repeated_rows(odd):
    import corpus_pipeline

    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(odd.sparkSession, odd, SF).collect()]
    assert sorted(x for x in got if x) == [1, 2, 3, 4, 5, 6, 7, 9, 10] and None in got


def test_pipeline_stages_on_odd_and_empty_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        got = [r["doc_id"] for r in stage(spark, odd, SF).collect()]
        if name == "language_id":
            assert set(got) <= {4, 5, 7, 8, 9, 10, 11, None} and {4, 5, 7, 11} <= set(got)
        elif name != "mixing":
            assert set(got) >= {1, 2, 3, 4, 5, 6, 7, 9, 10, None}, name
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    empty.select(corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_mostly_poor_documents(spark, docs, labels):
    """Where 95 of 100 labels say poor, mixing gives documents and no error."""
    import corpus_pipeline
    from strandline.llm.mixing import mix

    poor = labels.withColumn("quality", F.when(F.pmod("doc_id", F.lit(20)) == 0, 1).otherwise(0))
    assert mix(docs.select(corpus_pipeline.COLUMNS), poor).count() > 0


def test_word_spans_of_empty_documents():
    data = np.frombuffer(b"a b", np.uint8)
    s, e, at = word_spans(data, np.array([0, 0, 1, 3, 3]))
    assert s.tolist() == [0, 2] and e.tolist() == [1, 3] and at.tolist() == [0, 0, 1, 2, 2]
