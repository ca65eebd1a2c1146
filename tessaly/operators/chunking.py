"""Overlapping fixed-size windows over cleaned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions.text import as_column, lines, strip


def tidy_lines(value: Column | str) -> Column:
    """Lines stripped, blank ones dropped, joined by a line feed."""
    return F.array_join(F.filter(F.transform(lines(value), strip), lambda line: line != ""), "\n")


def window_array(clean: Column, size: int, overlap: int) -> Column:
    """All windows of one tidy text as an array; an empty text has none."""
    step = max(size - overlap, 1)
    length = F.length(clean)
    count = F.when(length <= size, 1).otherwise(F.ceil((length - size) / step) + 1).cast("int")
    return F.when(
        length > 0,
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(clean, i * step + 1, F.lit(size))),
    )


def split_text(
    df: DataFrame, text: Column | str = "body", size: int = 700, overlap: int = 100,
    index: str = "chunk_index", content: str = "content",
) -> DataFrame:
    """One row per window; narrow, no shuffle. The source text column is dropped."""
    tidy = df.withColumn("_tidy", tidy_lines(as_column(text)))
    keep = [c for c in df.columns if c != text]
    return tidy.select(*keep, F.posexplode(window_array(F.col("_tidy"), size, overlap)).alias(index, content))
