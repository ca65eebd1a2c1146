"""Token identifiers of whole texts with a given vocabulary file, in Arrow batches.

The vocabulary's pre-tokeniser never joins across ASCII white space, nor across a Latin letter and one of a few
ASCII signs. So a text is cut there, each different piece of a batch is encoded once by the tokenizer, and the
identifiers of the pieces are strung together. Texts that hold the opening of a special token are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
EDGE = re.compile(rf"([{LETTER}])([.,#*$%&|<>!?;:])")
PLAIN = re.compile(rf"[{LETTER}]+")
PIECES_A_CALL = 500
#: Pieces remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 250_000


class Encoder:
    """Wraps one tokenizer; ``encode`` gives little-endian unsigned 32-bit identifiers as bytes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        for name, number in names.items():
            self.ends_word[number] = name.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        plain, other = [], []
        for piece in pieces:
            word = piece.decode()
            (plain if PLAIN.fullmatch(word) else other).append(word)
        groups = [plain[i : i + PIECES_A_CALL] for i in range(0, len(plain), PIECES_A_CALL)]
        for group, ids in zip(groups, self.raw([" ".join(g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.ends_word[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(stops) != len(group):
                other += group
                continue
            start = 0
            for word, stop in zip(group, stops.tolist(), strict=True):
                self.known[word.encode()] = ids[start:stop]
                start = stop
        for word, ids in zip(other, self.raw(other), strict=True):
            self.known[word.encode()] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if "<|" in text else EDGE.sub(r"\1 \2", text).encode().lower().split() for text in texts]
        new = set().union(*(pieces for pieces in cut if pieces)) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*(pieces for pieces in cut if pieces))
        self.learn(list(new))
        look = self.known.__getitem__
        return [self.raw([text])[0] if pieces is None else b"".join(map(look, pieces)) for text, pieces in zip(texts, cut, strict=True)]


ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in ENCODERS:
        ENCODERS[vocabulary] = Encoder(vocabulary)
    return ENCODERS[vocabulary]


TOKENS = "doc_id bigint, part int, place bigint, n_ids bigint, ids binary"
#: Rows cut into pieces at once: a text takes some twenty times its bytes in pieces.
ROWS_A_CALL = 250


def tokenise(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """One row per document: its identifiers (with ``end_id`` behind them unless None), the number of the task
    that made it, and the count of identifiers the task made before it. Null texts are empty texts."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_CALL):
                batch = whole.slice(at, ROWS_A_CALL)
                ids = [x + tail for x in coder.encode([t or "" for t in batch.column("text").to_pylist()])]
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                places = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(places), pa.array(counts), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "place", "n_ids", "ids"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)
