"""MinHash near-duplicate groups by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its minimum and its
maximum, so `permutations` hash evaluations make 2 x permutations values. Values are cut into bands;
documents that agree on a band share a bucket. Links inside buckets are confirmed on the full shingle
sets and connected components give the groups.

Buckets are never expanded into all pairs. Equal word sequences are one class from the start. Each
bucket first compares its members with two of them, its smallest and a random one; where the confirmed
links already join a whole bucket, no further comparison can change the result. In buckets that still
span several components, every pair across components is then compared, by set sizes, by bit sketches
and then by hashed sets inside the join, so that only likely links leave it. Links are confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.llm.textkernel import chunk_ranges, mix, random_odds, sequence_digests, shingle_codes, shingle_hashes, utf8, word_codes, word_hashes

#: Bits of a sketch: one of each of the first signature values.
SKETCH = 192
SIGNATURES = "doc_id long, n_shingles long, key_a long, key_b long, sketch array<long>, bands array<long>"


def _signatures(permutations: int, rows: int, words: int, seed: int):
    """mapInArrow function: (doc_id, text) to signature rows."""
    factors = random_odds(permutations, seed)
    n_bands = 2 * permutations // rows
    salts = random_odds(n_bands * rows, seed + 1).reshape(n_bands, rows)
    tag = mix(np.arange(1, n_bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunk_ranges(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                w, at = word_hashes(part, o)
                h, begin = shingle_hashes(w, at, words)
                codes, _ = shingle_codes(word_codes(part, o)[0], at, words)
                n, full = j - i, np.flatnonzero(np.diff(begin) > 0)
                first = begin[full]
                sig = np.zeros((n, 2 * permutations), np.uint64)
                distinct = np.zeros(n, np.int64)
                if len(full):
                    for k in range(permutations):
                        y = h * factors[k]
                        sig[full, 2 * k] = np.minimum.reduceat(y, first)
                        sig[full, 2 * k + 1] = np.maximum.reduceat(y, first)
                    owner = np.repeat(np.arange(n), np.diff(begin))
                    distinct = np.bincount(np.unique((owner << 32) | codes) >> 32, minlength=n)
                keys = sequence_digests(part, o)
                bands = mix((sig.reshape(n, n_bands, rows) * salts).sum(axis=2, dtype=np.uint64) + tag)
                bits = (mix(sig) & np.uint64(1)).astype(np.uint8)[:, :SKETCH]
                bits = np.pad(bits, ((0, 0), (0, SKETCH - bits.shape[1])))
                sketch = np.packbits(bits, axis=1).view(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(distinct, pa.int64()),
                        *(pa.array(np.ascontiguousarray(keys[:, c])) for c in range(2)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(sketch)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "key_a", "key_b", "sketch", "bands"],
                )

    return run


def signatures(docs: DataFrame, permutations: int = 100, rows: int = 5, words: int = 5, seed: int = 7) -> DataFrame:
    """One row per input row: distinct shingles, content keys, a bit sketch and band keys."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures(permutations, rows, words, seed), SIGNATURES)


def links_of(left: pa.Array, right: pa.Array, words: int, percent: int) -> np.ndarray:
    """Whether the shingle sets of each pair of texts are alike enough; words and shingles are compared themselves, not by hashes."""
    n = len(left)
    data, off = utf8(pa.chunked_array([left, right]))
    codes, _, at = word_codes(data, off)
    grams, begin = shingle_codes(codes, at, words)
    owner = np.repeat(np.tile(np.arange(n), 2), np.diff(begin))
    key = (owner << 32) | grams
    a, b = np.unique(key[: begin[n]]), np.unique(key[begin[n] :])
    size = np.bincount(a >> 32, minlength=n) + np.bincount(b >> 32, minlength=n)
    both = np.bincount(np.intersect1d(a, b, assume_unique=True) >> 32, minlength=n)
    return (both > 0) & (100 * both >= percent * (size - both))


def _confirm(words: int, percent: int):
    """mapInArrow function: (a, b, text_a, text_b) to the pairs whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(utf8(batch.column(2))[1]) + np.diff(utf8(batch.column(3))[1])
            for i, j in chunk_ranges(np.concatenate([[0], np.cumsum(size)])):
                part = batch.slice(i, j - i)
                yield part.select([0, 1]).filter(pa.array(links_of(part.column(2), part.column(3), words, percent)))

    return run


def _items(words: int):
    """mapInArrow function: (doc_id, text) to the distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunk_ranges(off):
                w, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h, begin = shingle_hashes(w, at, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([np.unique(h[begin[d] : begin[d + 1]]).view(np.int64) for d in range(j - i)], pa.list_(pa.int64()))], ["doc_id", "items"])

    return run


def named_texts(ids: DataFrame, docs: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, text) of the documents that ids name; the ids are broadcast while there are at most `broadcast_ids` (16 MB), else the semi join is shuffled."""
    ids = materialize(ids.select("doc_id").distinct(), "near-ids")
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")


def shingle_sets(ids: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, items): the full set of shingle hashes of each named document."""
    return named_texts(ids, docs).mapInArrow(_items(words), "doc_id long, items array<long>").dropDuplicates(["doc_id", "items"])


def confirm_pairs(pairs: DataFrame, docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Pairs (a, b) of doc_ids whose full shingle sets have 100 * intersection >= percent * union; only texts that a pair names are moved."""
    texts = materialize(named_texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs), "near-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(words, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node: the smallest node reachable.

    Each round points every node at its smallest neighbour, follows pointers until none changes, and contracts the links
    to what they point at, until none is left. A node that two rounds leave in place has taken in another one, so that the
    nodes halve at least every two rounds, whatever the order of ids; pointers' lengths halve with every step.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "near-links")
    label = None
    while label is None or not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("up")), "near-parents")
        while True:
            over = parent.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("over"))
            moved = materialize(parent.join(over, "up").select("node", F.col("over").alias("up")), "near-moved")
            if moved.isEmpty():
                break
            parent = materialize(parent.unionAll(moved).groupBy("node").agg(F.min("up").alias("up")), "near-parents")
        if label is None:
            label = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            label = label.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        label = materialize(label, "near-labels")
        left, right = parent.select(F.col("node").alias("a"), F.col("up").alias("x")), parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = materialize(edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "near-links")
    return label


def crowded(classes: DataFrame) -> DataFrame:
    """(bucket, doc, centre, pivot): the members of every bucket that has two or more, with its smallest and a random one.

    Most buckets have one member. Keys alone are counted first, so that only the other buckets' members are aggregated and sorted as whole rows.
    """
    fact = F.struct("rep", "n_shingles", *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH // 64))).alias("doc")
    posted = classes.select(F.explode("bands").alias("bucket"), fact)
    crowds = posted.groupBy("bucket").count().where("count > 1").select("bucket")
    # hashed, as a merge join would sort all that is posted
    members = materialize(posted.join(crowds.hint("shuffle_hash"), "bucket", "left_semi"), "near-posted")
    ends = members.groupBy("bucket").agg(F.min("doc").alias("centre"), F.min(F.struct(F.xxhash64("doc.rep", "bucket").alias("h"), "doc")).alias("pivot"))
    return materialize(members.join(ends.select("bucket", "centre", F.col("pivot.doc").alias("pivot")), "bucket"), "near-buckets")


def near_duplicates(docs: DataFrame, permutations: int = 100, rows: int = 5, words: int = 5, percent: int = 75, block: int = 4096) -> DataFrame:
    """Near-duplicate groups of documents(doc_id, text, ...).

    Returns one row per input row: doc_id, n_shingles (distinct shingles), component_id (smallest doc_id
    reachable over links, its own included) and kept (doc_id = component_id). Rows with the same doc_id are
    one node. Null and empty texts have no shingles and no links; a null doc_id takes no part: its
    component_id is null and it is kept. Extra columns are ignored.

    Two steps may lose a link, both by chance and measured in the tests: a pair at exactly the similarity shares no band with
    probability about 2e-5, and passes the bound on differing sketch bits but for 1e-7. What is linked is linked by its words.
    """
    sig = materialize(signatures(docs, permutations, rows, words), "near-signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(some.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-classes")
    members = crowded(classes)

    bits = min(2 * permutations, SKETCH)
    chance = (1 - percent / 100) / 2
    most_off = bits * chance + 5.5 * (bits * chance * (1 - chance)) ** 0.5

    def alike(x: str, y: str):
        """Whether set sizes allow the similarity and the sketches differ by less than 5.5 deviations more than it implies."""
        off = sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(SKETCH // 64)), F.lit(0))
        return (F.least(f"{x}.n_shingles", f"{y}.n_shingles") * 100 >= F.greatest(f"{x}.n_shingles", f"{y}.n_shingles") * percent) & (off <= most_off)

    first = members.where((F.col("centre.rep") < F.col("doc.rep")) & alike("doc", "centre")).select(F.col("centre.rep").alias("a"), F.col("doc.rep").alias("b"))
    second = members.where((F.col("pivot.rep") != F.col("doc.rep")) & (F.col("pivot.rep") != F.col("centre.rep")) & (F.col("doc.rep") != F.col("centre.rep")) & alike("doc", "pivot")).select(F.least("pivot.rep", "doc.rep").alias("a"), F.greatest("pivot.rep", "doc.rep").alias("b"))
    pairs = materialize(first.unionAll(second).distinct(), "near-pairs")
    links = materialize(confirm_pairs(pairs, docs, words, percent), "near-confirmed")
    label = components(links)

    labelled = members.withColumn("rep", F.col("doc.rep")).join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "doc", F.coalesce("component", "rep").alias("component"), "centre", "pivot")
    labelled = materialize(labelled, "near-labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("bucket")
    open_ = materialize(labelled.join(split, "bucket").where("doc.rep <> centre.rep and doc.rep <> pivot.rep").select("bucket", "doc", "component"), "near-open")
    if not open_.isEmpty():
        sets = shingle_sets(open_.select(F.col("doc.rep").alias("doc_id")), docs, words)
        # a bucket is cut into blocks of members, and every pair of its blocks is a key of its own
        blocks = open_.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        full = open_.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("doc.rep", "bucket"), F.col("n")).cast("int"))
        full = full.withColumn("rep", F.col("doc.rep")).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        x = full.select("bucket", F.explode(F.sequence("own", F.col("n") - 1)).alias("j"), F.col("own").alias("i"), F.col("doc").alias("x"), F.col("component").alias("cx"), F.col("items").alias("sx"))
        y = full.select("bucket", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("doc").alias("y"), F.col("component").alias("cy"), F.col("items").alias("sy"))
        both = F.size(F.array_intersect("sx", "sy"))
        enough = both * (100 + percent) >= (F.size("sx") + F.size("sy")) * percent
        once = (F.col("x.rep") < F.col("y.rep")) | ((x["i"] < x["j"]) & (F.col("x.rep") != F.col("y.rep")))
        cross = x.join(y, (x["bucket"] == y["bucket"]) & (x["i"] == y["i"]) & (x["j"] == y["j"]) & once & (F.col("cx") != F.col("cy")) & alike("x", "y") & enough)
        rest = materialize(cross.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "near-pairs")
        found = materialize(confirm_pairs(rest, docs, words, percent), "near-confirmed")
        if not found.isEmpty():
            ends = label.select("node", "component")
            over = found.join(ends.toDF("a", "ca"), "a", "left").join(ends.toDF("b", "cb"), "b", "left")
            merged = components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).toDF("component", "up")
            alone = merged.join(label.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("up").alias("component"))
            label = label.join(merged, "component", "left").select("node", F.coalesce("up", "component").alias("component")).unionAll(alone)

    groups = classes.select("key_a", "key_b", "n_shingles", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key_a", "key_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(groups, ["key_a", "key_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
