"""Corpus pipeline: drop toxic texts, exact copies, near copies and leaking documents, then tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. No stage can be told in SQL, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from otflow.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from otflow.llm.common import materialize, table
from otflow.llm.queries import RANKS


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; trained on the labelled ones among docs.

    Null and empty texts are scored like any; rows that repeat each other go or stay together.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; null texts equal empty ones, and of rows that repeat each other one stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more, told by their shingles; rows are matched by id and text."""
    return simhash.drop_near_copies(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; texts decide, so null ids and repeated rows don't matter."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left; a null text has no tokens."""
    return bpe.round_trip(docs, RANKS)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("byte_bpe", tokenised),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
