"""Quality rules by compression bands.

zstandard is run over the whole document and over fixed chunks of it; the last chunk ends with the text and overlaps the
one before, and a text below the size of a chunk is one chunk with the limits of its own length. A ratio (compressed by plain bytes) below a band
means repetition, above it noise such as keys or encoded data. What is usual depends on the length, so each length
has limits of its own. Counts of words, signs and repeats come first (the base); a text that fails the base is not kept.

Null texts are empty texts: no words, base failed. Null and repeated ids and repeated rows are kept as they are; other
columns are ignored; an empty table gives no rows. Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.measures import boxed, with_measures

#: Texts below so many bytes, least ratio, largest ratio.
BANDS = ((256, 0.30, 1.80), (512, 0.30, 0.95), (1024, 0.28, 0.85), (4096, 0.25, 0.75), (16384, 0.20, 0.68), (None, 0.15, 0.62))
CHUNK = 2048
CHUNK_LOW, CHUNK_HIGH = 0.20, 0.72
#: A text goes when more than this share of its chunks lies outside the limits for chunks.
ODD_CHUNKS = 0.3
LEVEL = 3
BLANKS = b"\t\n\x0b\x0c\r "
SIGNS = b"#*$%&|<>"


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur more than once in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers = Numbers()
    code = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    key = code[:n]
    for i in range(1, width):
        # Numbered anew in each step, so that any vocabulary fits.
        key = np.unique(key * len(numbers) + code[i : i + n], return_inverse=True)[1] if i + 1 < width else key * len(numbers) + code[i : i + n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[back] > 1
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + n] |= often
    return int(inside.sum())


def duplicate_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    lines = [line for line in raw.split(b"\n") if line.translate(None, BLANKS)]
    return len(lines) - len(set(lines))


def count_text(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bytes, ratio, chunks outside the limits, chunks."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    ratio = len(packer.compress(raw)) / len(raw) if raw else 0.0
    if len(raw) < CHUNK:
        # The whole text is its only chunk, with the limits of its own length.
        low, high = next((low, high) for below, low, high in BANDS if below is None or len(raw) < below)
        odd, n_chunks = int(bool(raw) and not low <= ratio <= high), int(bool(raw))
    else:
        starts = list(range(0, len(raw) - CHUNK + 1, CHUNK))
        if len(raw) % CHUNK:
            starts.append(len(raw) - CHUNK)
        odd, n_chunks = sum(not CHUNK_LOW <= len(packer.compress(raw[i : i + CHUNK])) / CHUNK <= CHUNK_HIGH for i in starts), len(starts)
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, BLANKS))), len(raw) - len(raw.translate(None, SIGNS)), duplicate_lines(raw),
        repeat_words(words), len(raw), ratio, odd, n_chunks,
    )


COUNTS = {name: "bigint" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")} | {"ratio": "double", "odd_chunks": "bigint", "n_chunks": "bigint"}


def start_counting() -> Callable[[str | None], tuple]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return lambda text: count_text(text, packer)


def measure(rows: DataFrame) -> DataFrame:
    """Adds the counts of every text."""
    return with_measures(rows, start_counting, COUNTS)


def judge(measured: DataFrame, min_words: int = 50) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    usual = None
    for below, low, high in BANDS:
        fits = F.col("ratio").between(low, high)
        usual = fits if below is None and usual is None else (F.when(F.col("n_bytes") < below, fits) if usual is None else (usual.otherwise(fits) if below is None else usual.when(F.col("n_bytes") < below, fits)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & usual & (F.col("odd_chunks") <= F.col("n_chunks") * ODD_CHUNKS))


def judge_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    return judge(measure(boxed(docs).select("doc_id", "text"))).drop("text")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return judge(measure(boxed(docs).select("row", "text"))).where("kept").select("row.*")
