"""Numbers measured on each text in Arrow batches, as further columns of any table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_measures(rows: DataFrame, start: Callable[[], Callable[[str | None], tuple]], fields: dict[str, str]) -> DataFrame:
    """Adds the columns ``fields`` (name to type) that ``start()`` measures on the column ``text``. Only the text
    goes to Python; all other columns stay where they are. ``start`` runs once per task."""
    names = list(fields)

    @F.pandas_udf(", ".join(f"{name} {kind}" for name, kind in fields.items()))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        measure = start()
        for texts in batches:
            yield pd.DataFrame([measure(text) for text in texts], columns=names)

    return rows.withColumn("measured", measured(F.col("text"))).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col("measured")[name].alias(name) for name in names))


def boxed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns, safe from clashing names), ``doc_id`` and ``text``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
