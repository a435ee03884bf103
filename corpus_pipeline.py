"""Corpus pipeline: five stages over ``documents``, each written and reread.

Language ID rejects documents whose language can't be told, one document of each
group of near-duplicates (5-word shingles, similarity 0.8 or more) is kept, the
secret scan replaces secrets in the texts, mixing repeats or leaves out
documents to meet the sources' targets, and packing fills sequences of 1024
tokens. Every stage works on all rows that its predecessor kept; all but the
last return the columns of documents. Each gives an empty table for an empty
one; nulls, ties and repeated rows are as the operators state them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelstone.llm import language, mixing, packing, secrets, simhash
from keelstone.llm.common import as_table, documents, small_batches


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words' languages can be told; null texts and texts without a letter go, code-switched ones stay."""
    small_batches(spark)
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of least id, null ids last; rows are judged by their texts."""
    small_batches(spark)
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced where they stand; null and empty texts are unchanged."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, those not taken left out; null sources are one source."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence; a null text is an empty document."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", tell_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Forward-backward, components of links and forests have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of sf_dir's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
