"""A corpus pipeline: quality classifier, exact dedup, near-dedup, source mixing, BPE encoding.

Each stage is written as Parquet in the shared folder and read again by the next one.  All but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each
document of the mix (repeated documents are rows of their own).

Defined results: a document with a null or empty text, or without words, is rejected by the first stage; very long texts go through whole; rows
that repeat a text, whatever their ids, become one in the second stage (the longest original, then the least id; a null id comes last and is kept as null); of
a near-duplicate group the least id stays; rows that tie in all that decides are equal, and one of them stays; an empty table
gives an empty table with each stage's columns; further columns, whatever their names, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.bpe import encode_decode
from lexmill.llm.common import stage
from lexmill.llm.exact_dedup import dedup
from lexmill.llm.mixing import mixed_rows
from lexmill.llm.quality import keep_good
from lexmill.llm.queries import table, tokenizer_path
from lexmill.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("bpe", encoding)]

#: Fingerprints, the classifier and BPE have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
