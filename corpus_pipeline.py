"""From raw documents to packed training sequences: each stage works on what the one before it kept.

Defined cases: a null or empty text has the score of zero statistics and, if it is kept, is a sequence's piece with the end
mark alone; of rows with equal or near texts that with the least doc_id stays, null last; documents without labels, or
all if there are no good labels, are kept by the classifier's score; an empty benchmark removes nothing; empty documents
give no pieces; other columns of documents, whatever their names, pass through all stages but the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, near_duplicates, packing, pii, quality_pu
from linkloom.llm._common import documents, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_pu.good_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id."""
    return near_duplicates.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of one window."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("packing", packed),
]
#: No stage but the last two's base patterns could be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
