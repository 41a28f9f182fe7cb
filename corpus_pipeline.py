"""Corpus preparation over ``documents``: classify, dedup lines, dedup documents, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of ``documents``. SQL cannot express the trained classifier, the signatures and the packing, so
``ORACLE_SQL`` is None and tests hold the stages against plain versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import contamination, line_dedup, near_dup, packing, quality_model
from quillstream.llm.common import durable, release, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_model.accept(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line makes redundant."""
    return line_dedup.cut_lines(docs, line_dedup.repeated_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return near_dup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.clean_of(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
        if written is not None:
            release(written)
        written = docs
    return docs
