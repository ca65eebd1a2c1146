"""Concatenate and cut.

All token streams are thought to stand one behind the other. Pass one counts the tokens of each writing task and sums
the counts of the tasks before it; a document's place in the whole stream is its task's offset plus its place in the
task. Pass two cuts the stream into windows of fixed length by arithmetic alone: a document gives one piece per window it
touches, and a piece says whether the document goes on across the window's left or right boundary.

Rows with null texts are empty texts; null or repeated ids and repeated rows are packed like any other row. Other
columns are ignored. An empty table gives no piece. A document without tokens (only without ``end_id``) gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaly.llm.storage import materialise
from tessaly.llm.wordpiece import tokenise


def stream_offsets(tokens: DataFrame) -> DataFrame:
    """``part, before``: the tokens of all earlier tasks. One row per writing task, whatever the number of documents."""
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def cut_windows(tokens: DataFrame, window: int) -> DataFrame:
    """Pieces with their identifiers: every identifier of every document lies in exactly one piece."""
    placed = tokens.where("n_ids > 0").join(F.broadcast(stream_offsets(tokens)), "part").withColumn("at", F.col("before") + F.col("place"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n_ids") - 1) / window)
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest("at", F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("n_ids"), (F.col("sequence_id") + 1) * window)
    return pieces.select(
        "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("length"), F.col("n_ids").alias("doc_tokens"), "sequence_id",
        (low - F.col("sequence_id") * window).alias("offset"), (low > F.col("at")).alias("from_left"), (high < F.col("at") + F.col("n_ids")).alias("to_right"), "ids",
    ).withColumn("ids", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"))


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int | None = 2) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, from_left, to_right, ids``.

    Only the last window of the whole stream can be short. Token rows are written once, so texts are encoded once.
    """
    return cut_windows(materialise(tokenise(docs, vocabulary, end_id), "tokens"), window)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC of their identifiers in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "from_left", "to_right")
