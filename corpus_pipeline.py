"""
The corpus pipeline: toxicity, quality, near-duplicates, mixing, packing.

Each stage works on all that the stage before kept, and all but the last return the columns of documents. The last
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxscribe.llm import mixing, near_copies, packing, quality, toxicity
from voxscribe.llm.common import columns, table, written
from voxscribe.llm.queries import vocabulary_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    out = toxicity.classify(docs, table(spark, sf_dir, "labels"), carry=True)
    return out.where("not rejected").select(*columns(docs, "row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    out = quality.classify(docs, table(spark, sf_dir, "labels"), carry=True)
    return out.where("predicted = 1").select(*columns(docs, "row"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each time that words of a document are taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the packed sequences."""
    return packing.pack(docs, **vocabulary_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near-duplicates", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifiers of the first two stages can't be written in SQL; tests hold run() against plain versions of its stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
