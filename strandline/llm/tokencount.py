"""Token counts of flat, unindexed token files by separator scan.

A token file is a run of fixed-width unsigned ids in which one id ends each document. Blocks of a file are
searched for that id independently of each other; a block only tells how many ids stand before its first
separator, between separators and after the last. A segmented prefix scan over these block summaries then
gives every block what its first document has from earlier blocks, and its first document's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, new_path
from strandline.llm.tokens import default_path, encode_column

BLOCKS = "file string, block long, n_ids long, n_ends long, head long, tail long, inner array<long>"


#: What the two kinds of files of a run hold.
IDS, TOKENS = 0, 1


def _payload(path: str, width: int, run_bytes: int):
    """Runs of documents: a row with their tokens' ids, the end after all but the last document, and a row with their own ids, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        tokens: list[bytes] = []
        own: list[str] = []

        def closed() -> pa.RecordBatch:
            rows = [pa.array([",".join(own).encode(), b"".join(tokens)[:-width]], pa.binary()), pa.array([IDS, TOKENS], pa.int32()), pa.array([number] * 2, pa.int32())]
            tokens.clear()
            own.clear()
            return pa.RecordBatch.from_arrays(rows, ["ids", "kind", "run"])

        for batch in batches:
            names = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
            for first, _, ids, at in encode_column(batch.column(1), path):
                if len(ids) and int(ids.max()) + 1 >= 1 << 8 * width:
                    raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
                raw = np.insert(ids.astype(f"<u{width}") + np.array(1, f"<u{width}"), at[1:], 0).tobytes()
                end = (at + np.arange(len(at))) * width
                # an id counts with 16 bytes, so that runs of empty documents end too
                cost = np.cumsum(np.diff(end) + 16)
                i, n = 0, len(cost)
                while i < n:
                    spent = int(cost[i - 1]) if i else 0
                    j = min(int(np.searchsorted(cost, spent + run_bytes - size, "left")) + 1, n)
                    tokens.append(raw[end[i] : end[j]])
                    own += names[first + i : first + j]
                    size += int(cost[j - 1]) - spent
                    if size >= run_bytes:
                        yield closed()
                        number, size = number + 1, 0
                    i = j
        if own:
            yield closed()

    return run


def write_token_files(docs: DataFrame, at: str, path: str | None = None, width: int = 2, run_bytes: int = 1 << 24) -> None:
    """Write documents as flat token files: little-endian ids of `width` bytes, each one more than the tokenizer's, 0 ending a document.

    The files are written by Spark's own writer, whatever store `at` is in, one for each run of documents: a run is closed when it has
    run_bytes (16 a document counted in), so a file is at most that and one document long. Beside each stands, from the same pass, a file with the
    ids of its documents in their order (a null id is empty). Both are found by the task's number in the file's name and the run's in its folder.
    """
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_payload(path or default_path(), width, run_bytes), "ids binary, kind int, run int")
    ids.select(F.col("ids").cast("string"), "kind", "run").write.option("lineSep", "\0" * width).partitionBy("kind", "run").text(at)


def _scan(end_id: int, width: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(content.as_buffer(), f"<u{width}")
                rows = []
                step = block_bytes // width
                for k in range(0, max(len(ids), 1), step):
                    block = ids[k : k + step]
                    ends = np.flatnonzero(block == end_id)
                    head, tail = (int(ends[0]), len(block) - 1 - int(ends[-1])) if len(ends) else (0, len(block))
                    rows.append((file, first + k // step, len(block), len(ends), head, tail, np.diff(ends) - 1))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())))], ["file", "block", "n_ids", "n_ends", "head", "tail", "inner"])

    return run


def separator_scan(parts: DataFrame, end_id: int = 0, width: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """Documents of token files given as parts(file, first_block, content).

    A part is any run of whole blocks of a file; only its last may be short. One row per document: file, doc_index
    (from 0 in its file), n_tokens without the separator, and closed, which is false for ids after a file's last
    separator. Files without ids give no row; a document may span any number of blocks.
    """
    scanned = parts.select("file", F.col("first_block").cast("long"), "content").mapInArrow(_scan(end_id, width, block_bytes), BLOCKS)
    blocks = materialize(scanned, "token-blocks")
    # the scan over blocks sees their summaries only; lengths inside a block wait for its number
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.drop("inner").withColumn("run", F.sum((F.col("n_ends") > 0).cast("int")).over(order)).withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    carried = runs.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block"))).withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("last", F.lead("block").over(order).isNull())
    carried = materialize(carried, "token-carry")
    whole = carried.where("n_ends > 0").join(blocks.select("file", "block", "inner"), ["file", "block"])
    closed = whole.select("file", "first", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("doc_index"), "n_tokens", F.lit(True).alias("closed"))
    rest = carried.where("last and open > 0").select("file", (F.col("first") + F.col("n_ends")).alias("doc_index"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionAll(rest)


def _files(spark: SparkSession, at: str, kind: int) -> DataFrame:
    """Files of a kind, named by their run's folder and the number of the task that wrote them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{at}/kind={kind}")
    name = F.concat_ws("/", F.regexp_extract("path", r"/(run=\d+)/", 1), F.regexp_extract("path", r"/(part-\d+)[^/]*$", 1))
    return files.select(name.alias("file"), "content")


def token_files(spark: SparkSession, at: str) -> DataFrame:
    """Token files of a folder of write_token_files as parts for separator_scan, a file (below 2 GB) a part; larger ones have to be given in parts."""
    return _files(spark, at, TOKENS).select("file", F.lit(0).alias("first_block"), "content")


def file_documents(spark: SparkSession, at: str) -> DataFrame:
    """(file, doc_index, doc_id) of all documents of a folder of write_token_files."""
    own = F.split(F.rtrim(F.col("content").cast("string"), F.lit("\0")), ",")
    each = _files(spark, at, IDS).select("file", F.posexplode(own).alias("doc_index", "doc_id"))
    return each.select("file", F.col("doc_index").cast("long").alias("doc_index"), F.when(F.col("doc_id") != "", F.col("doc_id")).cast("long").alias("doc_id"))


def count_documents(docs: DataFrame, path: str | None = None, width: int = 2) -> DataFrame:
    """doc_id, file, doc_index and n_tokens of every row of documents(doc_id, text, ...), by way of flat token files in the shared folder.

    Null and empty texts have 0 ids; repeated rows and null ids count each on its own; extra columns are ignored. The documents are read
    once: tokens and ids of a run are written by one pass, so any frame will do, whatever the order of its rows. A document that stands
    in one kind of file only is an error.
    """
    spark = docs.sparkSession
    at = new_path(spark, "token-files")
    write_token_files(docs, at, path, width)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, file string, doc_index long, n_tokens long")
    counted = separator_scan(token_files(spark, at), width=width).withColumn("counted", F.lit(True))
    both = counted.join(file_documents(spark, at).withColumn("named", F.lit(True)), ["file", "doc_index"], "full")
    sound = F.col("counted").isNotNull() & F.col("named").isNotNull()
    return both.select("doc_id", F.when(sound, F.col("file")).otherwise(F.raise_error(F.lit("token and id files differ")).cast("string")).alias("file"), "doc_index", "n_tokens")
