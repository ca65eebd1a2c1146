"""Runs of words against the definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessaly.llm import periodic_runs
from tessaly.llm.queries import QUERIES
from tessaly.llm.storage import read_table

SF_DIR = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(words, exponent=4, min_length=6):
    """All runs by looking at each period, the least period of each stretch."""
    n, found = len(words), {}
    numbers = {}
    code = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for period in range(1, n // exponent + 1):
        equal = np.concatenate(([0], (code[:-period] == code[period:]).astype(np.int8), [0]))
        change = np.diff(equal)
        for start, end in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            length = end - start + period
            if length >= max(min_length, exponent * period):
                found.setdefault((start, length), period)
    return sorted((start, length, period) for (start, length), period in found.items())


def plain_digest(words):
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def with_tail(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_table(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode().split()) for r in read_table(spark, SF_DIR, "documents").collect()]
    assert rows_of(QUERIES["op13_periodic_runs"](spark, SF_DIR)) == sorted(((i, *plain_digest(with_tail(i, w))) for i, w in docs), key=str)


@pytest.mark.parametrize("exponent", [4, 5])
def test_many_small_texts(exponent):
    chance = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(chance.randint(1, 6)):
            words = [chance.randrange(chance.choice([1, 2, 3, 8])) for _ in range(chance.choice([0, 1, 5, 24, 90, 200]))]
            for _ in range(chance.randint(0, 3)):
                if len(words) > 8:
                    start, period = chance.randrange(len(words)), chance.randint(1, len(words) // 3)
                    for i in range(start, min(len(words), start + chance.randint(1, len(words)))):
                        words[i] = words[start + (i - start) % period]
            texts.append([str(w).encode() for w in words])
        assert periodic_runs.runs_of_texts(texts, exponent, 6) == [plain_runs(t, exponent) for t in texts]


def test_equal_exponents_and_runs_that_overlap():
    # Both runs have exponent 6; the first one counts. The last one shares its first word with the one before.
    words = b"a a a a a a x b c b c b c b c b c b c d d d d d d d".split()
    assert plain_digest(words)[:5] == (3, 19, 7, 1, 7000)
    assert plain_runs(b"a b a b a b a a a a a a".split()) == [(6, 6, 1)]
    assert periodic_runs.runs_of_texts([b"a b a b a b a a a a a a".split(), words], 4, 6) == [[(6, 6, 1)], plain_runs(words)]


def test_odd_rows(spark, monkeypatch):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (4, "a a a a a"), (5, "a a a a a a"), (5, "x"), (None, "b c b c b c b c d"), (6, "tok " * 30_000), (7, "u v w " * 10_000), (8, "é\u00a0é " * 8),
    ]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as runs", "'x' as top", "'y' as start", "2 as n_words")
    found = rows_of(periodic_runs.digest(periodic_runs.find_runs(odd)))
    small = [(i, *plain_digest((t or "").encode().split())) for i, t in rows if i not in (6, 7)]
    large = [r for r in found if r[0] in (6, 7)]
    assert [r for r in found if r[0] not in (6, 7)] == sorted(small, key=str)
    assert [r[:6] for r in large] == [(6, 1, 0, 30_000, 1, 30_000_000), (7, 1, 0, 30_000, 3, 10_000_000)]
    assert found[0][:6] == (1, 0, None, None, None, None) and found[0][6:] == (EMPTY, EMPTY)
    # A text alone in its batch and many texts in one give the same rows.
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 1)
    assert rows_of(periodic_runs.digest(periodic_runs.find_runs(odd))) == found
    tails = {r["doc_id"]: r["text"] for r in periodic_runs.with_tails(odd).where("doc_id = 8 or doc_id = 1").collect()}
    assert tails[1] == "" and tails[8].encode().split() == with_tail(8, ("é\u00a0é " * 8).encode().split())
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_tails(odd.where("doc_id = -1")))).count() == 0
