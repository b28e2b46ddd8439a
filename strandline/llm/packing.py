"""First-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents are cut into full sequences and one remainder. Remainders go to randomised groups of bounded
size, so no group grows with the input, and each group is packed on its own: pieces in falling length, each
into the first open bin that still holds it, found in a tournament tree of the bins' free room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.llm.tokens import default_path, encode_column

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(path: str, room: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, at in encode_column(batch.column(1), path):
                n = np.diff(at) + 1
                full = np.full(int(n.sum()), end_id, "<u4")
                keep = np.ones(len(full), bool)
                keep[np.cumsum(n) - 1] = False
                full[keep] = ids
                parts = -(-n // room)
                owner = np.repeat(np.arange(j - i), parts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * room
                length = np.minimum(room, n[owner] - start)
                first = (np.cumsum(n) - n)[owner] + start
                view = memoryview(full).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                doc = batch.column(0).slice(i, j - i).take(pa.array(owner))
                rows = np.arange(row, row + len(owner))
                row += len(owner)
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, n[owner], np.full(len(owner), part), rows))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row"])

    return run


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; equal lengths keep their order."""
    n = len(lengths)
    leaves = 1 << max(n - 1, 0).bit_length()
    free = [room] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, room - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack_group(room: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("part", "ascending"), ("row", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), room)
        number = group["pack"].to_numpy()
        out = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array((number << 24) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, room: int = 1024, end_id: int = 0, path: str | None = None, group_rows: int = 8192) -> DataFrame:
    """Pack documents(doc_id, text, ...) into sequences of at most `room` ids.

    A document is its tokenizer ids and then end_id; null text counts as empty, so every row, repeated rows and
    null ids included, gives at least one piece. One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset; offsets of a sequence are gapless from 0. Extra columns are ignored. Groups hold about
    group_rows remainders; there are as many groups as that takes, and a group's bins are numbered within it.
    """
    path = path or default_path()
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(path, room, end_id), PIECES)
    pieces = materialize(pieces, "pack-pieces")
    rest = pieces.where(F.col("length") < room)
    groups = max(1, -(-rest.count() // group_rows))
    packed = rest.withColumn("pack", F.pmod(F.xxhash64("part", "row"), F.lit(groups))).groupBy("pack").applyInArrow(pack_group(room), PACKED)
    alone = (F.lit(1 << 62) + F.shiftleft("part", 36) + F.col("row")).alias("sequence_id")
    full = pieces.where(F.col("length") >= room).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", alone, F.lit(0).cast("long").alias("offset"))
    return full.unionAll(packed)
