"""The registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.ann import nearest
from strandline.llm.collocation import collocations
from strandline.llm.common import table
from strandline.llm.fingerprint import fingerprints
from strandline.llm.langid import held_out_languages
from strandline.llm.lm import score_documents
from strandline.llm.mixing import mixture
from strandline.llm.neardup import near_duplicates
from strandline.llm.packing import pack
from strandline.llm.pii import personal_data
from strandline.llm.quality import score_quality
from strandline.llm.runs import periodic_ends, run_digests
from strandline.llm.sharding import shard_documents
from strandline.llm.tokencount import count_documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the four fifths that are not held out."""
    return held_out_languages(table(spark, sf_dir, "documents"))


def op2_separator_scan_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document of flat token files made from the documents."""
    return count_documents(table(spark, sf_dir, "documents"))


def op3_first_fit_decreasing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op4_balanced_posting_lists_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram and unigram scores of every document, learnt from nine tenths."""
    return score_documents(table(spark, sf_dir, "documents"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return personal_data(table(spark, sf_dir, "documents"))


def op7_improbable_feature_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring their domains' expected token totals to the target weights."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of whole documents: five-word shingles, similarity 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_boosted_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by their ids, with the shard each would have among 25."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op13_baier_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of all documents, about every tenth of which gets a periodic end."""
    return run_digests(periodic_ends(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    each = (op1_hyperdimensional_language_id, op2_separator_scan_token_counts, op3_first_fit_decreasing_packing, op4_balanced_posting_lists_ann, op5_brown_class_lm, op6_weak_supervision_pii, op7_improbable_feature_fingerprints, op8_soft_membership_mixing, op9_minmax_near_dedup, op10_boosted_tree_quality, op11_trie_collocations, op12_jump_hash_sharding, op13_baier_lyndon_runs)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    from strandline.llm.oracles import ORACLES

    return dict(ORACLES)
