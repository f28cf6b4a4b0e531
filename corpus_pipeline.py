"""Training-data pipeline: documents to packed token sequences, in stages that are each written and read again.

Every stage takes whole documents with all their columns and returns those that stay, unchanged. Rows are told apart by
id and text: of two rows that share an id, one may go and the other stay, but for near copies, where an id names one
document with all its texts. Null ids are documents like any other; a null text counts as empty; an empty table goes
through as an empty table; very long texts are judged whole; rows that repeat share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import crc, staged, table, without
from logweir.llm.decontaminate import decontaminate
from logweir.llm.exact_dedup import exact_dedup
from logweir.llm.near_dedup import near_dedup
from logweir.llm.packing import pack_documents
from logweir.llm.quality import quality_scores, row_id


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more, learned from the labels outside the held-out fold. Without usable
    labels every score is 0.5, so nothing stays; empty texts are scored as any other."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"), train=crc(row_id()) % 4 != 2)
    return without(docs, scores.where("predicted = 0"), "doc_id", "text")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id; ties (the same id and text) all stay, and a null id
    only where all have one."""
    return without(docs, exact_dedup(docs).where("not kept"), "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; texts without words are in no group and stay."""
    return without(docs, near_dedup(docs).where("not kept"), "doc_id")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; all of them where there are no items with words."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"), "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences of at most 2048 tokens; an empty text is a piece of
    one token, and rows that repeat are packed each."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("pack", pack)]

#: Scores and tokens have no SQL form: tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
