"""Connected components of a link table by least-label propagation with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node reachable over links ``a, b``. Rounds go on until no label changes; each halves
    chains, and its labels are written to the shared folder."""
    both = materialise(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialise(lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if not step.where("label <> old").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")
