"""Quality by a sparse rule ensemble.

Statistics of every text are measured once. A small random forest is fitted on labelled rows; every path from a root to
a node is a conjunctive rule over the statistics. A logistic regression with an L1 penalty weighs the rules, most weights
become zero, and the rest is compiled into one Spark column expression.

Null texts are empty texts and are scored like others. Null ids have no fold and are not held out; repeated rows are
scored alike. Other columns are ignored. Without labels of both classes the score is the share of label 1, or 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import zstandard
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.llm.labelled import FIT_ROWS, HELD_OUT, fold, labelled_rows
from tessaly.llm.measures import boxed, with_measures
from tessaly.llm.quality_rules import LEVEL, count_text
from tessaly.llm.storage import materialise

STATISTICS = (
    "n_words", "word_chars", "symbols", "dup_lines", "repeats", "ratio", "different", "longest", "capitals", "digits", "stops", "bars", "line_words", "short_words", "function_words",
)
THRESHOLD = 0.7
PENALTY = 0.002
#: A rule is a set of conditions: (statistic, "<=" or ">", limit).
Rule = tuple[tuple[str, str, float], ...]
#: Frequent words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("the of and to in is that for with was on as by at from be it a der die das und ist von den zu mit für ein le la les de des et est que une un en el los las y por para con".split())


def statistics_of(text: str | None, packer: zstandard.ZstdCompressor) -> tuple[float, ...]:
    text = text or ""
    n, chars, symbols, doubled, repeats, size, ratio, _, _ = count_text(text, packer)
    words, length, lines = text.split(), max(1, len(text)), text.count("\n") + 1
    some = max(1, n)
    different = set(words)
    return (
        float(n), chars / some, symbols / length, doubled / lines, repeats / some, ratio, len(different) / some, float(max(map(len, different), default=0)),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / length, sum(map(text.count, "0123456789")) / length, sum(map(text.count, ".!?")) / some,
        text.count("|") / some, n / lines, sum(1 for w in words if len(w) <= 3) / some, sum(1 for w in words if w in FUNCTION_WORDS) / some,
    )


def start_statistics() -> Callable[[str | None], tuple]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return lambda text: statistics_of(text, packer)


def with_statistics(rows: DataFrame) -> DataFrame:
    return with_measures(rows, start_statistics, dict.fromkeys(STATISTICS, "double"))


def extract_rules(forest: RandomForestClassificationModel) -> list[Rule]:
    """Every path from a root to a node, once; conditions on one statistic in one direction are drawn together."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in forest.toDebugString.splitlines():
        condition = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not condition:
            continue
        depth = len(condition[1])
        path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(condition[2])], condition[3], float(condition[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, way, limit) in path:
            known = tight.get((name, way), limit)
            tight[name, way] = min(known, limit) if way == "<=" else max(known, limit)
        rules.add(tuple(sorted((name, way, limit) for (name, way), limit in tight.items())))
    return sorted(rules)


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, way, limit in rule:
        out = out & (F.col(name) <= limit if way == "<=" else F.col(name) > limit)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[tuple[Rule, float]], float] | None:
    """Rules with weights other than zero, and the constant; None when a class is missing."""
    sample = labelled_rows(docs, labels, "quality", rows)
    measured = materialise(with_statistics(sample.select("doc_id", "label", "text")), "quality-rows")
    if measured.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(measured)
    forest = RandomForestClassifier(numTrees=20, maxDepth=3, maxBins=64, seed=7, featureSubsetStrategy="0.5").fit(assembled)
    rules = extract_rules(forest)
    matrix = measured.select("label", F.array(*[condition(r).cast("double") for r in rules]).alias("held"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(matrix.select("label", array_to_vector("held").alias("features")))
    return [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w], float(model.intercept)


def compile_rules(rules: list[tuple[Rule, float]], constant: float) -> Column:
    total = F.lit(constant)
    for rule, weight in rules:
        total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    fitted = fit(docs, labels, rows)
    plain = boxed(docs).select("doc_id", "text")
    held = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    if fitted is None:
        share = labels.where(fold(F.col("doc_id")) != HELD_OUT).agg(F.avg("quality")).first()[0] or 0.0
        return plain.select("doc_id", held, F.lit(float(share)).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    return with_statistics(plain).select("doc_id", held, compile_rules(*fitted).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
