"""Shared helpers of the training-data operators: shared storage, row keys, table reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import new_path, shared_dir, shuffle_parts
from strandline.storage import written as materialize

__all__ = ["ascii_lower", "id_crc", "materialize", "new_path", "shared_dir", "shuffle_parts", "small_batches", "table"]

#: The ASCII white space that separates words in the contracts.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 8 MB: rows hold whole texts, and workers need a few batches at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())
