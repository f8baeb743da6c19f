"""The stages of the corpus pipeline over documents, each reading what the one before kept.

A stage returns the columns of documents (``COLUMNS``); others are left behind
by the first stage, so that what is written between stages is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm.common import cut, table
from tidewake.llm.decontamination import without_leaks
from tidewake.llm.mixing import mixed
from tidewake.llm.quality_classifier import accepted
from tidewake.llm.sharding import shard_documents
from tidewake.llm.simhash import one_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of this stage's input.

    Null and empty texts are scored as texts without words; equal texts get one
    score; without labels of both kinds all documents share one score; an
    empty table stays empty.
    """
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id (null last; ties: any fixed one).

    Texts without words, null ones too, are one group; an empty table stays
    empty.
    """
    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and an empty table stays empty."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it: not at all, once or several times.

    Null sources are a source of their own; texts without words are never
    taken; equal rows are taken together; an empty table stays empty.
    """
    return mixed(docs.select(*COLUMNS))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; equal texts share a shard, null texts are a group of their own, repeated rows take a slot each."""
    return shard_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SimHash components and a fitted classifier cannot be written as DuckDB SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
