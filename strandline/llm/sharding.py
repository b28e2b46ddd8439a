"""Sharding by jump consistent hashing of stable keys.

A key's shard follows from the key and the number of shards alone: a linear congruential sequence seeded by the key tells at which
shard counts it jumps, and its shard is the last jump below the count. No table of the ring is kept, and where shards are appended
a key either stays or goes to one of the new ones. Numbers within a shard come from ranges of the ids: each range counts its own
rows by shard, and a table with a row for each range and shard carries what the ranges before it hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, shuffle_parts

#: Multipliers of a 64-bit finaliser and of the key's sequence.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 2862933555777941757
NUMBERED = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, nth long"


def spread(keys: np.ndarray) -> np.ndarray:
    """Keys as well-spread 64-bit numbers, one to one."""
    x = keys.astype(np.int64).view(np.uint64)
    for shift, by in ((30, MIX[0]), (27, MIX[1])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def jump(keys: np.ndarray, *counts: int) -> list[np.ndarray]:
    """The shard of each 64-bit key for each of the rising shard counts.

    All keys jump together; a key whose next jump lies beyond the largest count is done.
    """
    state, here = keys.astype(np.uint64), np.zeros(len(keys))
    out = [np.zeros(len(keys), np.int32) for _ in counts]
    alive = np.arange(len(keys))
    while len(alive):
        for shard, count in zip(out, counts, strict=True):
            inside = here < count
            shard[alive[inside]] = here[inside]
        state = state * np.uint64(STEP) + np.uint64(1)
        here = np.floor((here + 1) * (2.0**31 / ((state >> np.uint64(33)) + np.uint64(1)).astype(float)))
        on = here < counts[-1]
        alive, state, here = alive[on], state[on], here[on]
    return out


def _shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = spread(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, jump(key, shards, shards + 1))], [*batch.schema.names, "shard", "grown_shard"])

    return run


def _number(shards: int):
    """Adds the range's number and each row's place among the range's rows of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            shard = batch.column(3).to_numpy()
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            nth = np.empty(len(shard), np.int64)
            nth[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.full(len(shard), part, np.int32)), pa.array(nth)], [*batch.schema.names[:5], "part", "nth"])

    return run


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of documents(doc_id, text, ...).

    The law is `key`: doc_id and the number of shards decide; grown_shard is the shard with one more. Slots count a shard's rows from 0
    by doc_id, then text_crc32 and size; rows equal in all three take any of their slots. A null text has no bytes (size 8, crc 0); a null doc_id is the key 0
    and comes first. Rows of one id are in one shard however many they are, and are still numbered in several ranges. Extra columns are ignored.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # texts end here: ranges are drawn and dealt from rows of five numbers
    placed = materialize(rows.mapInArrow(_shards(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int"), "shards")
    keys = ["doc_id", "text_crc32", "size", "_row"]
    dealt = placed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    ranges = materialize(dealt.mapInArrow(_number(shards), NUMBERED), "shard-ranges")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # a row for each range and shard: bounded by shuffle partitions, whatever the rows are
    slots = ranges.join(F.broadcast(counts), ["shard", "part"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """docs as Parquet under a folder shard=<k> for each shard, all columns kept; a column `shard` of docs is an error.

    Rows are not shuffled: each task appends to the shards it meets, so a hot key is written by many tasks.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("documents already have a column named shard")
    names = docs.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    keyed = docs.select(F.col("doc_id").cast("long").alias("_key"), *names)
    placed = keyed.mapInArrow(_shards(shards), "_key long, " + schema + "shard int, grown_shard int")
    placed.drop("_key", "grown_shard").write.partitionBy("shard").parquet(path)
