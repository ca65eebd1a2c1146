"""Spelling variants against a plain search by patterns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessaly.llm import spelling_trees
from tessaly.llm.queries import QUERIES
from tessaly.llm.storage import read_table

SF_DIR = "/root/testdata/sf0.01"


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_groups(counts, times=10):
    by_hole = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            by_hole[word[:i], word[i + 1 :]].add(word)
    near = defaultdict(set)
    for (front, back), words in by_hole.items():
        shorter = front + back
        for word in words:
            near[word] |= words - {word}
            if shorter in counts:
                near[word].add(shorter)
                near[shorter].add(word)
    forms = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= times * n else None
    rows = []
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        rows.append((word, forms[word], root, n, len(near[word]), counts.get(forms[word])))
    return sorted(rows)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF_DIR, "documents").collect()]
    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF_DIR)) == plain_groups(plain_words(rows))


def some_words(seed, n):
    chance = random.Random(seed)
    words = {"".join(chance.choice("abcéÿ") for _ in range(chance.randint(7, 9))): chance.choice([2, 2, 3, 25, 30, 300, 4000]) for _ in range(n)}
    for base in ("resolutionary", "internationalised"):
        # Chains of forms, equal counts, and every kind of edit.
        words |= {base: 5000, base[1:]: 500, base[2:]: 50, base[2:] + "x": 5, "q" + base: 5000, base[:4] + "z" + base[5:]: 20, base[:4] + base[5] + base[4] + base[6:]: 30}
    return words


@pytest.mark.parametrize(("sample", "cell", "leaf", "block"), [(200_000, 20_000, 8, 1_000_000), (50, 40, 2, 30), (10_000, 25, 1, 7)])
def test_cells_and_blocks_do_not_matter(spark, monkeypatch, sample, cell, leaf, block):
    for name, value in (("SAMPLE", sample), ("CELL", cell), ("LEAF", leaf), ("BLOCK", block)):
        monkeypatch.setattr(spelling_trees, name, value)
    words = some_words(3, 700)
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows_of(spelling_trees.group_spellings(frame)) == plain_groups(words)


def test_words_of_the_same_letters(spark, monkeypatch):
    monkeypatch.setattr(spelling_trees, "BLOCK", 100)
    chance = random.Random(5)
    words = {"".join(chance.sample("abcdefgh", 8)): 2 for _ in range(400)} | {"abcdefgg": 40, "abcdefg": 30}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows_of(spelling_trees.group_spellings(frame)) == plain_groups(words)


def test_trees_reach_what_they_hold():
    chance = np.random.default_rng(2)
    points = chance.integers(0, 4, (500, spelling_trees.AXES)).astype(np.uint8)
    tree = spelling_trees.Tree(points, 4)
    assert sorted(tree.order) == list(range(500)) and tree.size[tree.axis < 0].sum() == 500
    raised = points.copy()
    raised[np.arange(500), chance.integers(0, 32, 500)] += 1
    both = raised.copy()
    axis = np.array([chance.choice(np.flatnonzero(row)) for row in both])
    both[np.arange(500), axis] -= 1
    for sought, lowering in ((raised, False), (both, True)):
        query, leaf = tree.reached(points, lowering)
        pairs = set(zip(query.tolist(), leaf.tolist()))
        node = np.zeros(500, int)
        for i in range(500):
            while tree.axis[node[i]] >= 0:
                node[i] = tree.left[node[i]] if sought[i, tree.axis[node[i]]] <= tree.cut[node[i]] else tree.right[node[i]]
            assert (i, int(node[i])) in pairs
        assert len(pairs) < 500 * (tree.axis < 0).sum() / 2


def test_odd_rows(spark):
    long = "z" * 4_000
    rows = [(1, None), (2, ""), (3, "12 -- \n"), (4, "Variant variant VARIANT"), (4, "Variant variant VARIANT"), (None, "variants variants ÀÉÎÕÜÿà ÀÉÎÕÜÿà"), (5, f"{long} {long}a {long} {long}a"), (6, "variamt variamt don't short ship ship")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as word", "'x' as n", "'y' as form", "2 as length", "3 as cell", "4 as own")
    words = {r["word"]: r["n"] for r in spelling_trees.count_words(odd).collect()}
    assert words == {"variant": 6, "variants": 2, "ÀÉÎÕÜÿà": 2, long: 2, long + "a": 2, "variamt": 2}
    assert rows_of(spelling_trees.group_spellings(spelling_trees.count_words(odd))) == plain_groups(words)
    spelt = spelling_trees.count_words(odd.where("doc_id is not null"), 1, 1, spelling_trees.variants)
    assert {r["word"] for r in spelt.where("length(word) > 6").collect()} == {w for w in plain_words([(i, f"{t} {t}" if t else t) for i, t in rows if i is not None])}
    assert spelling_trees.group_spellings(spelling_trees.count_words(odd.where("doc_id = -1"))).count() == 0
