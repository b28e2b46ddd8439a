"""Collocations, sharding and runs against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import collocation, oracles, runs, sharding

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "One two", "en"), (5, "a b " * 400, "de"), (5, "a b " * 400, "de"), (None, "no id: a b a b", None), (7, " ".join(f"w{i % 900}" for i in range(60_000)), "fr"), (8, "Ünï ünï, ÜNÏ. 日本 語 " * 40, "fr"), (-9, "x", "en")]
SCHEMA = "doc_id long, text string, lang string, f long, n long, shard int, score double, word string, codes string, start long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 1, 1, 0.5, "w", "c", 1) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_collocations(rows, least, longest=5, most=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        gone = {q[i : i + k] for q, b in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * often[q[i : i + k]]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in gone:
                score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").unionByName(odd.select("lang", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r) for r in collocation.collocations(docs, least=12).collect())
    assert got == brute_collocations(rows, 12) and len({len(r[2].split(" ")) for r in got}) == 4


def test_collocations_in_blocks(spark, monkeypatch):
    """With blocks of a few words and phrases nothing changes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    rows = [tuple(r) for r in docs.collect()]
    for name, value in (("WORDS", 150), ("PHRASES", 60), ("HELD", 40), ("KEYS", 50), ("CHUNK", 2000)):
        monkeypatch.setattr(collocation, name, value)
    assert sorted(tuple(r) for r in collocation.collocations(docs, least=40, most=30).collect()) == brute_collocations(rows, 40, most=30)


def test_scores_beyond_64_bits(spark):
    n = 40_000
    got = collocation.collocations(spark.createDataFrame([("x", "a b " * n)], "lang string, text string"), least=100).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations([("x", "a b " * n)], 100)


def test_collocations_of_nothing(none, odd):
    assert collocation.collocations(none).count() == 0
    assert collocation.collocations(odd, least=10**6).count() == 0
    assert set(collocation.collocations(odd).columns) == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_trie_holds_its_phrases():
    rng = np.random.Generator(np.random.PCG64(2))
    rows = np.unique(np.where(np.arange(4) < rng.integers(2, 5, 3000)[:, None], rng.integers(1, 30, (3000, 4)), 0), axis=0).astype(np.int32)
    trie = collocation.build_trie(rows, 30)
    codes = rng.integers(0, 31, 20_000).astype(np.int32)
    asked = {tuple(r[r > 0]) for r in rows}
    beginnings = {p[:k] for p in asked for k in range(2, 5)}
    for k, (at, state) in enumerate(trie.advance(codes, 4), 2):
        want = [i for i in range(len(codes) - k + 1) if tuple(codes[i : i + k]) in beginnings]
        assert at.tolist() == want
        for i, s in zip(at.tolist(), state.tolist()):
            row = trie.row[s]
            assert tuple(trie.phrases[row][:k]) == tuple(codes[i : i + k]) and trie.own[row] == (tuple(codes[i : i + k]) in asked)


def jump_loop(key, count):
    here, ahead = -1, 0
    while ahead < count:
        here = ahead
        key = (key * sharding.STEP + 1) % 2**64
        ahead = int((here + 1) * (2**31 / ((key >> 33) + 1)))
    return here


def test_jump_equals_a_loop():
    keys = sharding.spread(np.array([0, 1, -1, 2**62, -(2**63), *range(500)]))
    for count in (1, 2, 24, 1000):
        one, more = sharding.jump(keys, count, count + 1)
        assert one.tolist() == [jump_loop(int(k), count) for k in keys] and more.tolist() == [jump_loop(int(k), count + 1) for k in keys]
        assert all(b in (a, count) for a, b in zip(one.tolist(), more.tolist()))
    shard, grown = sharding.jump(sharding.spread(np.arange(240_000)), 24, 25)
    assert np.abs(np.bincount(shard) / 10_000 - 1).max() < 0.05 and abs((shard != grown).mean() - 1 / 25) < 0.002


def test_shards_of_odd_rows(spark, odd, none):
    got = sharding.shard_documents(odd, 5).collect()
    assert len(got) == len(ODD)
    want = sorted((i if i is not None else None, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ODD if i is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == want
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 5) for r in got) and len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.shard_documents(none).count() == 0
    hot = spark.range(3000).select((F.col("id") % 3 * 0).alias("doc_id"), F.lit("t").alias("text"))
    assert sorted(r.slot for r in sharding.shard_documents(hot).collect()) == list(range(3000))


def test_shards_equal_sql(spark, tmp_path):
    rows = [(i, t) for i, t, _ in ODD if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(oracles.SHARDS).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sharding.shard_documents(docs).collect())


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/s", 7)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    want = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 7).collect()}
    assert all(want[r.doc_id] == r.shard for r in back.collect())
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("SHARD", F.lit(1)), f"{tmp_path}/t")


def brute_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


def brute_lyndon(codes):
    out = []
    for i in range(len(codes)):
        j = i + 1
        while j < len(codes) and codes[i:] < codes[j:]:
            j += 1
        out.append(j - i)
    return out


def strings(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, k = rng.randint(1, 70), rng.randint(1, 4)
        x = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 9)
            x = [x[i] if i < a else x[a + (i - a) % min(p, n - a)] for i in range(n)]
        yield x
    a, b = [1], [1, 2]
    for _ in range(9):
        a, b = b, b + a
    yield b
    yield [1 + bin(i).count("1") % 2 for i in range(256)]


def test_lyndon_lengths_and_runs_equal_brute_force():
    for x in strings(3):
        assert runs.lyndon_lengths(np.array(x, np.int32)).tolist() == brute_lyndon(x)
        got = runs.runs_of(np.array([*x, 0, *x], np.int32), 2)
        want = brute_runs(x, 2)
        assert [(s, e - s, p) for s, e, p in zip(*map(np.ndarray.tolist, got))] == want + [(s + len(x) + 1, n, p) for s, n, p in want]
        s, e, p = runs.word_runs(np.array([*x, *x, *x], np.int32), np.array([0, len(x), 2 * len(x), 3 * len(x)]))
        one = brute_runs(x)
        assert [*zip(s.tolist(), (e - s).tolist(), p.tolist())] == [(a + d * len(x), n, q) for d in range(3) for a, n, q in one]


def test_sums_that_agree_by_chance(monkeypatch):
    """Where sums of words say that more is alike than is, the words decide."""
    monkeypatch.setattr(runs.Extensions, "alike", lambda self, a, p, size: np.ones(len(a), bool))
    for x in ([1, 2] * 8 + [3, 4, 5], [5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 4]):
        s, e, p = runs.runs_of(np.array(x, np.int32), 12)
        assert [*zip(s.tolist(), (e - s).tolist(), p.tolist())] == brute_runs(x)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{size},{q}\n" for s, size, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests_equal_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 9000").select("doc_id", "text").unionByName(odd.where("length(text) < 9000 or text is null").select("doc_id", "text"))
    rows = docs.collect()
    want = sorted((expected(*r) for r in rows), key=str)
    got = sorted((tuple(r) for r in runs.run_digests(runs.periodic_ends(docs)).collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in got) >= 8
    assert runs.run_digests(runs.periodic_ends(none)).count() == 0
    long = {r.doc_id: r for r in runs.periodic_runs(odd).collect() if r.doc_id in (7, 1)}
    assert [tuple(x) for x in long[7].runs] == [(0, 60_000, 900)] and long[7].collapsed.count(" ") == 899 and long[1].n_words == 0 and long[1].runs == []
