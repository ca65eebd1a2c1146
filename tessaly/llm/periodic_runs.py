"""Runs of words: stretches that repeat with a fixed period, found with string synchronising sets.

A run is a stretch of consecutive words in which words ``period`` apart are equal, ``period`` being the least such number,
that is at least ``exponent`` periods long and that no neighbouring word extends.

At each scale ``t`` = 1, 2, 4, ... every block of ``t`` words has a hash. A position is chosen if the least hash among the
blocks that start at it and at the ``t`` following positions belongs to the first or the last of them. So whether a position is chosen
depends on the ``2 t`` words from it on alone (its context): wherever these recur, the choice recurs. Blocks inside runs of a period of at
most ``t / exponent`` are left out, or a chosen position would stand in each of their short periods; those regions are
known from the smaller scales, which have supplied their runs.

In a run of period ``q`` with ``t <= q < 2 t`` some position in each ``t`` is chosen, for else it lay in a region of a smaller period,
which would be the period of the run. The same position one period on has the same context, and no chosen position
between them has. So neighbours in the list of chosen positions, sorted by context and place, that are ``t`` to ``2 t - 1``
apart propose all periods of the scale. Each chain of proposals is extended word by word to both sides, hence no run
rests on a hash, and none is missed.

Many texts are searched at once: they stand one behind the other, parted by marks that occur once. A batch holds whole
texts; long ones come alone. Null texts have no words; null and repeated ids and repeated rows are kept as they are; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch of texts is searched when it holds so many words.
BATCH_WORDS = 200_000
NONE = np.uint64(2**64 - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def doubled(hashes: np.ndarray, step: int) -> np.ndarray:
    """Hashes of blocks of ``2 * step`` words from those of ``step`` words."""
    return mixed(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:]) if len(hashes) > step else hashes[:0]


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def highly_periodic(runs: Iterable[tuple[int, int, int]], scale: int, exponent: int, n: int) -> np.ndarray:
    """Where blocks of ``scale`` words lie in a run of a period of at most ``scale / exponent``."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        if period * exponent <= scale <= length and start + length <= n:
            change[start] += 1
            change[start + length - scale + 1] -= 1
    return np.cumsum(change[:-1]) > 0


def chosen_positions(hashes: np.ndarray, scale: int, skipped: np.ndarray) -> np.ndarray:
    """The synchronising set of a scale: positions whose context of ``2 * scale`` words lies inside the words."""
    order = np.where(skipped[: len(hashes)], NONE, hashes)
    least = least_of(order, scale + 1)
    return np.flatnonzero((least != NONE) & ((least == order[: len(least)]) | (least == order[scale : scale + len(least)])))


def extended(words: np.ndarray, first: int, last: int, period: int) -> tuple[int, int, int]:
    """The whole stretch with this period around the equal words ``first .. last`` and ``first + period ..``."""
    low = first
    while low:
        reach = min(low, 4 * period)
        differ = np.flatnonzero(words[low - reach : low] != words[low - reach + period : low + period])
        if len(differ):
            low = low - reach + int(differ[-1]) + 1
            break
        low -= reach
    high, n = first, len(words)
    step = max(4 * period, last - first)
    while high + period < n:
        reach = min(n - high - period, step)
        differ = np.flatnonzero(words[high : high + reach] != words[high + period : high + period + reach])
        if len(differ):
            high += int(differ[0])
            break
        high += reach
    return low, high + period - low, period


def runs_of(words: np.ndarray, lengths: np.ndarray, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs among numbered words, sorted.

    ``lengths`` are those of the texts in it, longest first, each with its closing mark; at each scale only texts that can hold a
    run of such a period are looked at."""
    hashes = mixed(words.astype(np.uint64) + np.uint64(1))
    ends = np.cumsum(lengths)
    found: dict[tuple[int, int], int] = {}
    scale = 1
    while True:
        able = int(np.searchsorted(-lengths, -(exponent * scale + 1), side="right"))
        if not able:
            break
        n = int(ends[able - 1])
        hashes = hashes[: n - scale + 1]
        contexts = doubled(hashes, scale)
        runs = [(start, length, period) for (start, length), period in found.items()]
        at = chosen_positions(hashes, scale, highly_periodic(runs, scale, exponent, n))
        at = at[at < len(contexts)]
        order = np.argsort(contexts[at], kind="stable")
        at, context = at[order], contexts[at[order]]
        gap = np.diff(at)
        proposed = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
        # Proposals of one run, each beginning where the one before ends, are one chain.
        follows = np.zeros(len(gap), bool)
        follows[1:] = proposed[1:] & proposed[:-1] & (gap[1:] == gap[:-1])
        begins = np.flatnonzero(proposed & ~follows)
        closes = np.flatnonzero(proposed & ~np.append(follows[1:], False))
        for one, other in zip(begins.tolist(), closes.tolist()):
            start, length, period = extended(words[:n], int(at[one]), int(at[other]), int(gap[one]))
            if length >= exponent * period:
                found[start, length] = min(period, found.get((start, length), period))
        hashes, scale = contexts, 2 * scale
    return sorted((start, length, period) for (start, length), period in found.items())


def runs_of_texts(texts: list[list[bytes]], exponent: int, min_length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    lengths = np.array([len(texts[i]) + 1 for i in order], np.int64)
    words = np.empty(int(lengths.sum()), np.int64)
    ends = np.cumsum(lengths)
    for place, i in enumerate(order):
        end = int(ends[place])
        words[end - len(texts[i]) - 1 : end - 1] = [numbers[w] for w in texts[i]]
        words[end - 1] = -2 - place
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(words, lengths, exponent):
        if length >= min_length:
            place = int(np.searchsorted(ends, start, side="right"))
            runs[order[place]].append((start - int(ends[place] - lengths[place]), length, period))
    return runs


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(words).decode()
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept)).decode()


FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def find_runs(docs: DataFrame, exponent: int = 4, min_length: int = 6) -> DataFrame:
    """``doc_id``, ``n_words``, the ``runs`` of every text by start and period, and the text ``collapsed``: its words joined by one
    space, of each run only the first period."""
    def searched(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, exponent, min_length)
        rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in one] for one in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        collapsed = pa.array([without_repeats(words, one) for words, one in zip(texts, runs)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(words) for words in texts], pa.int64()), rows, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                words = (text.as_py() or "").encode().split()
                if held and held + len(words) > BATCH_WORDS:
                    yield searched(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(words)
                held += len(words) + 1
        if ids:
            yield searched(ids, texts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the run of the largest exponent (the first of equal ones), and digests of all runs and of
    the collapsed text."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    top = F.aggregate("runs", F.lit(None).cast(kind), lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"), F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents, the tails of one in ten made periodic: with the CRC ``h`` of the id, words from
    ``(h // 10) % n`` on repeat the first ones of them, three to ten times. Ids say it all, so every run makes the same texts."""
    @F.pandas_udf("string")
    def tailed(ids, texts):
        def one(doc_id, text):
            words = text.encode().split()
            h, n = zlib.crc32(str(doc_id).encode()), len(words)
            start = h // 10 % n if n else 0
            if h % 10 or not n:
                return text
            period = 1 + (n - start) // (3 + h // 10 % 8)
            return b" ".join(words[:start] + [words[start + i % period] for i in range(n - start)]).decode()

        return texts.combine(ids, lambda text, doc_id: one(int(doc_id), text))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Only those texts go to Python whose id asks for it.
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    ids = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(chosen, tailed(ids, F.when(chosen, text).otherwise(""))).otherwise(text).alias("text"))
