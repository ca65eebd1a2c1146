"""Bounded labelled rows for fitting, and the fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2
#: Rows a model is fitted on, about. Beyond it a hashed share of the labelled rows is used.
FIT_ROWS = 20_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo four; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text, label, fold`` of documents with a label outside the held-out fold; at most about ``rows``.

    The labels sent to all executors are those rows' ids, so their size has the same bound.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label")).where(f"doc_id is not null and label in (0, 1)")
    known = known.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    share = min(1.0, rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id", "fold").agg(F.max("label").alias("label"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
