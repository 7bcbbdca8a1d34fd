"""A pipeline over the documents: language ID, near-dedup, secrets, mixing, packing. Each stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm.common import dropped, scratch, written
from demandspark.llm.language_id import keep_known, learn_profiles
from demandspark.llm.mixing import mixed_documents
from demandspark.llm.near_copies import dedup
from demandspark.llm.packing import pack
from demandspark.llm.secret_scan import redact_secrets


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; those without letters, or far from every profile, go.

    A null or empty text goes, a very long one counts whole; rows that repeat stay, and an empty table gives no rows."""
    return keep_known(docs, learn_profiles(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 0.8 or more by shingles of five words) the document with the smallest id."""
    return dedup(docs, least=0.8, width=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows.

    Null and empty texts, repeated rows and empty tables stay as they are."""
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, up to three times each, so that the sources come near their targets.

    Documents without words (null, empty) are not taken; equal rows are documents of their own; an empty table gives none."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048, their ids included.

    A null text is empty; repeated rows are packed each; an empty table gives no pieces."""
    return pack(docs, with_ids=True)


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: SQL has neither the profiles nor the fingerprints nor the tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's tables are deleted when its result is written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch():
            new = written(stage(spark, docs, sf_dir), keep=True)
        dropped(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
