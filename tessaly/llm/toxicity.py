"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows: units much more frequent in toxic texts than in
others (near copies counted once). Dense features: densities of lexicon words, their nearness to words for the second
person, capitals, punctuation, and rates of disguised words (signs or digits for letters, drawn-out letters). Trees are
fitted on folds 0 and 1, the isotonic curve on fold 3; fold 2 is held out.

Null texts are empty texts and are scored like others. Null ids have no fold and are not held out; repeated rows are
scored alike. Other columns are ignored. Without labels of both classes the score is the share of label 1, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.hyperminhash import shingle_set
from tessaly.llm.labelled import FIT_ROWS, HELD_OUT, fold, labelled_rows
from tessaly.llm.measures import boxed, with_measures
from tessaly.llm.storage import materialise

#: Words for the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tú tus vosotros".split())
#: Signs that stand for letters.
DISGUISE = str.maketrans("@4310$5!7", "aaeiossit")
WORD = re.compile(r"[^\W_]+")
DISGUISED = re.compile(r"[^\W\d_]+[@$!*#0-9]+[^\W\d_]+")
DRAWN_OUT = re.compile(r"([^\W\d_])\1\1")
BEGINNINGS = (4, 5, 6)
#: Size of the lexicon and the least evidence of a unit (texts times log ratio).
LEXICON_SIZE, LEAST_EVIDENCE = 3000, 8.0
NEAR = 3
#: Score from which a text is called toxic.
#: Labelled texts that are not toxic, per toxic one, from which the lexicon learns what is usual (by hash of the text).
OTHER_TEXTS = 2
THRESHOLD = 0.3
FEATURES = ("hits", "hit_rate", "hit_kinds", "word_hits", "near_you", "best_window", "disguised_hits", "capitals", "shouted", "exclaims", "marks", "disguised", "drawn_out", "n_words")


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> list[str]:
    """Units of toxic texts, most telling first; at most ``size``. ``rows`` is the bounded sample."""
    def first_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(s[0].view(np.int64)) if len(s) else 0 for s in sets], pa.int64())], [*batch.schema.names, "mark"])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                (toxic if label else other).update(words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n})
        names = [*toxic, *(u for u in other if u not in toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([other[u] for u in names], pa.int64())], ["unit", "toxic", "other"])

    once = materialise(rows.select("text", "label").mapInArrow(first_hash, "text string, label double, mark bigint").dropDuplicates(["mark"]), "lexicon-rows")
    totals = once.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")).first()
    toxic, other = totals["toxic"] or 0, totals["other"] or 0
    if not toxic or not other:
        return []
    share = min(1.0, OTHER_TEXTS * toxic / other)
    some = once.where((F.col("label") == 1) | (F.pmod(F.col("mark"), F.lit(10_000)) < int(share * 10_000))).select("text", "label")
    counts = some.mapInArrow(units, "unit string, toxic bigint, other bigint").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    usual = toxic / (toxic + share * other)
    evidence = F.col("toxic") * F.log(F.col("toxic") / (F.col("toxic") + F.col("other")) / F.lit(usual))
    found = counts.where("toxic >= 3").withColumn("evidence", evidence).where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("toxic") >= 4 * F.col("other")))
    return [r["unit"] for r in found.orderBy(F.desc("evidence"), "unit").limit(size).collect()]


def text_features(text: str | None, words_of: frozenset[str], starts_of: frozenset[str]) -> tuple[float, ...]:
    text = text or ""
    words = WORD.findall(text.lower())
    n = len(words)
    exact = words_of.intersection(words)
    begun = {w for w in set(words) if w[:4] in starts_of or w[:5] in starts_of or w[:6] in starts_of} if starts_of else set()
    kinds = exact | begun
    at = [i for i, w in enumerate(words) if w in kinds] if kinds else []
    near = sum(1 for i in at if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    best = max((sum(1 for j in at[k : k + 30] if j < i + 30) for k, i in enumerate(at)), default=0)
    disguised = DISGUISED.findall(text) if any(c in text for c in "@$!*#0123456789") else []
    plain = [d.lower().translate(DISGUISE) for d in disguised]
    seen = sum(1 for d in plain if d in words_of or any(d[:k] in starts_of for k in BEGINNINGS))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if upper else 0
    size, some = max(1, len(text)), max(1, n)
    marks = sum(map(text.count, ".,;:?!"))
    return (
        float(len(at)), 100.0 * len(at) / some, float(len(kinds)), float(sum(1 for i in at if words[i] in exact)), float(near), float(best), float(seen), upper / size, shouted / some,
        (text.count("!") + text.count("?")) / some, marks / size, len(disguised) / some, sum(1 for _ in DRAWN_OUT.finditer(text)) / some, math.log1p(n),
    )


def with_features(rows: DataFrame, lexicon: list[str]) -> DataFrame:
    """Adds the features of every text."""
    words_of = frozenset(u for u in lexicon if not u.endswith("*"))
    starts_of = frozenset(u[:-1] for u in lexicon if u.endswith("*"))
    return with_measures(rows, lambda: lambda text: text_features(text, words_of, starts_of), dict.fromkeys(FEATURES, "double"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """The lexicon, the boosted trees and the isotonic curve; None for the models when a class is missing."""
    sample = labelled_rows(docs, labels, "toxic", rows)
    lexicon = learn_lexicon(sample.where("fold in (0, 1)"))
    featured = materialise(with_features(sample.select("doc_id", "label", "fold", "text"), lexicon), "toxic-rows")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)
    seen = {(r["fold"] == 3, r["label"]) for r in featured.groupBy("fold", "label").count().collect()}
    if not {(False, 0.0), (False, 1.0)} <= seen:
        return lexicon, None, None
    trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, maxBins=64, seed=7).fit(assembled.where("fold in (0, 1)"))
    curve_rows = assembled.where("fold = 3") if {(True, 0.0), (True, 1.0)} <= seen else assembled
    raw = trees.transform(curve_rows).select(vector_to_array("probability")[1].alias("raw"), "label").groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    curve = IsotonicRegression(featuresCol="raw", weightCol="weight", predictionCol="score").fit(raw)
    return lexicon, trees, curve


def add_scores(rows: DataFrame, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Adds ``score`` to rows with a text; the models are learned from ``docs`` and ``labels``."""
    lexicon, trees, curve = fit(docs, labels, fit_rows)
    if trees is None:
        share = labels.where(fold(F.col("doc_id")) != HELD_OUT).agg(F.avg("toxic")).first()[0] or 0.0
        return rows.withColumn("score", F.lit(float(share)))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows, lexicon)).select(*rows.columns, "features")
    scored = curve.transform(trees.transform(assembled).withColumn("raw", vector_to_array("probability")[1]))
    return scored.select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    scored = add_scores(boxed(docs).select("doc_id", "text"), docs, labels)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not called toxic."""
    return add_scores(boxed(docs).select("row", "text"), docs, labels).where(F.col("score") < threshold).select("row.*")
