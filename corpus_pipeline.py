"""A training-data pipeline over documents: language, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, small_batches, table
from strandline.llm.langid import identify
from strandline.llm.mixing import mix
from strandline.llm.neardup import near_duplicates
from strandline.llm.packing import pack
from strandline.llm.pii import mask

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of dropped duplicates are broadcast up to this many (16 MB); beyond, the anti join is shuffled.
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters look like one of the languages that labelled documents have.

    A document goes if it has no letter, or if its cosine with every language is below half of what 99 of 100 labelled documents
    reach with their own: noise of letters. Null and empty texts go; very long ones are read whole; repeated rows fare alike;
    other columns than those of documents are dropped. Without labelled documents every one with a letter stays.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    scored = materialize(identify(docs, docs, COLUMNS), "stage-languages")
    own = scored.where("lang = lang_pred")
    if own.isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    cut = own.approxQuantile("score", [0.01], 0.002)[0] / 2
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= cut)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, once.

    Null and empty texts are in no group and stay, as do null ids; of rows with the same id one stays, the first by a hash of its text.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = materialize(near_duplicates(docs), "stage-groups")
    gone = materialize(groups.where("not kept").select("doc_id").distinct(), "stage-gone")
    small = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    twice = materialize(groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "stage-twice")
    n = twice.count()
    if n == 0:
        return left
    twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    again = left.join(twice, "doc_id", "left_semi")
    first = again.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_n = 1")
    return left.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionAll(first.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every personal data span replaced by its kind, n_chars renewed; null texts, empty ones and repeated rows stay as they are."""
    small_batches(spark)
    return mask(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say: the good ones keep their tokens, poor and toxic ones get their target weight.

    Null and empty texts have no tokens and rates of their statistics; repeated rows fare alike. Without labels all posteriors are equal.
    """
    return mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; null and empty texts are one piece with the end alone."""
    small_batches(spark)
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mixing), ("packing", packing)]
#: SQL expresses neither the language profiles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
