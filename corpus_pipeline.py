"""From raw documents to packed training sequences: quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with all their columns; the last returns the packed pieces. `run` writes
each stage's result as Parquet in the shared folder and reads it again for the next.

Defined results: null and empty texts are judged as any others (the classifier scores all-zero statistics; of several the one with the largest id stays); rows that repeat an id are told apart by
their texts; very long texts are read whole and packed in pieces; an empty table gives no rows; further columns travel along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import exact_dedup, near_dedup, packing, quality
from mapweave.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of those given that are not held out."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("packing", pack)]
#: The stages are not expressible in SQL (a learned model, alignments and a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
