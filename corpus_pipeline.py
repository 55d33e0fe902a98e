"""Documents to training tokens: five stages, each on all that its predecessor kept.

Every stage takes null and repeated ids, null, empty and very long texts, ties, empty tables and further columns of any
name, and judges each row by its own text; its docstring says what becomes of them. All but the last keep the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from albumen.llm import bpe, decontaminate, langid, ngram_join, substring_dedup
from albumen.llm.storage import read_table, store


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected: those without a letter, null and empty ones among them, go."""
    return langid.keep_identified(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; equal rows under that id all stay."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document with a smaller id; what loses all its words goes.

    Rows under one id do not shorten one another; rows without an id stay whole.
    """
    return substring_dedup.remove_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an empty benchmark takes none away."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, a row for each row; null text has no ids."""
    import public_tokenizers

    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.roundtrip_digest(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard", distinct_texts),
    ("substring_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None  # hashing to a subword model and byte-level BPE have no SQL form; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
