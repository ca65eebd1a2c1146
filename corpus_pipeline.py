"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept and returns the documents it keeps, with the columns of ``documents``;
the last one returns packed pieces. Between stages the rows are written to the shared folder and read back, so a lost
executor costs no more than the stage it was at.

In every stage null texts are empty texts, repeated rows and rows without id are judged like any other, further columns of the table
stay as they are, whatever their names, and an empty table gives an empty one. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaly.llm import hyperminhash, packing, quality_rules, toxicity, winnowing
from tessaly.llm.queries import vocabulary
from tessaly.llm.storage import materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the threshold go. Empty texts are scored as well. Without labels of both kinds all rows get the share of toxic labels."""
    return toxicity.keep_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base or the limits go; empty texts fail the base."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least id stays; rows without id or words stay."""
    return hyperminhash.keep_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with at least a twentieth of their words in windows of items go; rows without words stay."""
    return winnowing.keep_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows; an empty text is its end mark."""
    return packing.digest(packing.pack(docs, vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Boosted trees, compression and token identifiers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
