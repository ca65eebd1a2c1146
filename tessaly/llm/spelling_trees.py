"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

A word is a point whose coordinates are the counts of its letters (accented ones share a few coordinates). Putting in a letter
raises one coordinate by one; replacing one raises one coordinate and lowers one. So words one edit apart lie at an L1 distance of two at most,
and in a tree that parts points at counts, a search goes down a side only if it crosses at most one cut upwards, and for
words of equal length one downwards. Words meet per pair of lengths: each with its own, and with the length above.

1. Words are counted in the tasks that read them, then once over all.
2. The upper cuts of each length's tree come from a bounded sample (``SAMPLE`` words by hash; it decides only how evenly
   cells are filled). Every word lies in the cell of its point and is sent to all other cells that its search reaches.
3. Each cell is a task of its own: it builds the lower tree over its words, searches it for all words sent there, drops pairs whose
   counts differ too much, and compares the letters of the rest in order. It gives one row per word, not pairs.
4. These rows are added up; forms are followed to their roots by pointer doubling.

Null texts have no words; null ids count as the text ``null`` in the hash of misspellings only; repeated ids and rows count as often as they
occur; other columns are ignored; an empty table gives no rows. Words of any length are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.storage import materialise

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Different words that a counting task holds before it gives them on.
HELD_WORDS = 200_000
#: Words that the upper cuts are fitted on, at most about.
SAMPLE = 200_000
#: Words a cell should hold, and points a leaf may hold.
CELL, LEAF = 20_000, 8
#: Pairs compared at once in a task.
BLOCK = 1_000_000
AXES = 32
#: The axis of each code point: a-z have their own, all others share the remaining six.
AXIS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)


def variants(doc_id, words: Counter) -> Iterator[tuple[str, int]]:
    """The words of a document, one in 31 misspelt: the CRC of id and word decides which letter is missing."""
    prefix = f"{'null' if doc_id is None else doc_id}:".encode()
    for word, n in words.items():
        h = zlib.crc32(prefix + word.encode())
        if h % 31 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def plain(doc_id, words: Counter) -> Iterator[tuple[str, int]]:
    return iter(words.items())


def count_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, spell: Callable = plain) -> DataFrame:
    """``word, n``: how often each word of at least ``min_length`` letters occurs, if at least ``min_count`` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                words = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))
                for word, n in spell(doc_id.as_py(), words):
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield given()
        yield given()

    parts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letters(words: list[bytes], length: int) -> np.ndarray:
    """One row of code points per word of one length (Latin-1)."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """The count of each axis, 250 at most: a bound that no two counts grow apart by."""
    n = len(codes)
    flat = (np.arange(n)[:, None] * AXES + AXIS[codes]).ravel()
    return np.minimum(np.bincount(flat, minlength=n * AXES).reshape(n, AXES), 250).astype(np.uint8)


def thermometer(counts: np.ndarray) -> np.ndarray:
    """Two 64-bit words per point whose different bits number no more than the L1 distance: four bits per axis."""
    bits = np.packbits(counts[:, :, None] > np.arange(4, dtype=np.uint8), axis=None).reshape(len(counts), AXES * 4 // 8)
    return np.ascontiguousarray(bits).view(np.uint64)


class Tree:
    """A k-d tree over letter counts: cuts at nodes, ranges of ``order`` at leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.cut, self.left, self.right, self.begin, self.size = [], [], [], [], [], []
        self.order = np.arange(len(points))
        self._grow(points, 0, len(points), leaf)
        self.axis, self.cut, self.left, self.right, self.begin, self.size = (np.array(x, np.int64) for x in (self.axis, self.cut, self.left, self.right, self.begin, self.size))

    def _grow(self, points: np.ndarray, begin: int, end: int, leaf: int) -> None:
        """Nodes are numbered as they are met; a stack stands for the recursion, so that trees may be deep."""
        stack = [(begin, end, -1, False)]
        while stack:
            begin, end, parent, is_right = stack.pop()
            node = len(self.axis)
            for field, value in ((self.axis, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.begin, begin), (self.size, end - begin)):
                field.append(value)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if end - begin <= leaf:
                continue
            inside = self.order[begin:end]
            mine = points[inside]
            best = best_cut(mine)
            if best is None:
                continue
            self.axis[node], self.cut[node] = best
            low = mine[:, best[0]] <= best[1]
            middle = begin + int(low.sum())
            self.order[begin:end] = np.concatenate((inside[low], inside[~low]))
            stack += [(middle, end, node, True), (begin, middle, node, False)]

    def reached(self, points: np.ndarray, lowering: bool) -> tuple[np.ndarray, np.ndarray]:
        """``query, leaf`` of all leaves that hold points with at most one count raised by one and, if ``lowering``, one lowered."""
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        up, down = np.ones(len(points), bool), np.full(len(points), lowering)
        queries, leaves = [], []
        while len(query):
            done = self.axis[node] < 0
            queries.append(query[done])
            leaves.append(node[done])
            query, node, up, down = query[~done], node[~done], up[~done], down[~done]
            value, cut = points[query, self.axis[node]].astype(np.int64), self.cut[node]
            low = value <= cut
            # Across the cut with one letter more, or one less.
            to_right, to_left = low & (value == cut) & up, ~low & (value == cut + 1) & down
            over = to_right | to_left
            near = np.where(low, self.left[node], self.right[node])
            far = np.where(low, self.right[node], self.left[node])[over]
            query, node = np.concatenate((query, query[over])), np.concatenate((near, far))
            up, down = np.concatenate((up, (up & ~to_right)[over])), np.concatenate((down, (down & ~to_left)[over]))
        return np.concatenate(queries) if queries else query, np.concatenate(leaves) if leaves else node


def best_cut(points: np.ndarray) -> tuple[int, int] | None:
    """The axis and count that part the points most evenly; nothing if all are equal."""
    best, uneven = None, len(points)
    for cut in range(4):
        low = (points <= cut).sum(0)
        axis = int(np.abs(2 * low - len(points)).argmin())
        if abs(2 * low[axis] - len(points)) < uneven:
            best, uneven = (axis, cut), abs(2 * int(low[axis]) - len(points))
    if best is None:
        high, low = points.max(0).astype(int), points.min(0).astype(int)
        axis = int((high - low).argmax())
        best = (axis, (high[axis] + low[axis]) // 2) if high[axis] > low[axis] else None
    return best


def near_pairs(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the rows of letters are exactly one edit apart; the rows of ``other`` are as long or one letter longer."""
    length = one.shape[1]
    if other.shape[1] == length:
        return (one != other).sum(1) == 1
    same_front = np.logical_and.accumulate(one == other[:, :length], axis=1).sum(1)
    same_back = np.logical_and.accumulate((one == other[:, 1:])[:, ::-1], axis=1).sum(1)
    return same_front + same_back >= length


def searched(tree: Tree, points: np.ndarray, point_bits: np.ndarray, point_codes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks ``query, point`` of the words one edit apart."""
    lowering = codes.shape[1] == point_codes.shape[1]
    bits = thermometer(counts)
    for at in range(0, len(codes), 20_000):
        query, leaf = tree.reached(counts[at : at + 20_000], lowering)
        query = query + at
        size = tree.size[leaf]
        ends = np.cumsum(size)
        first = 0
        while first < len(query):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, side="right")))
            # A leaf of equal points may hold any number of words, so it is met in blocks as well.
            widest = int(size[first]) if last == first + 1 else 0
            for skip in range(0, max(widest, 1), BLOCK):
                part = np.minimum(size[first:last] - skip, BLOCK) if widest else size[first:last]
                q = np.repeat(query[first:last], part)
                begins = tree.begin[leaf[first:last]] + skip
                p = tree.order[np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + np.repeat(begins, part)]
                far = np.bitwise_count(bits[q, 0] ^ point_bits[p, 0]) + np.bitwise_count(bits[q, 1] ^ point_bits[p, 1])
                fit = np.flatnonzero(far <= 2)
                q, p = q[fit], p[fit]
                near = near_pairs(codes[q], point_codes[p])
                yield q[near], p[near]
            first = last


#: What a cell knows about a word: near words in it, and the most frequent of them.
PARTIAL = "word string, n_near bigint, form_n bigint, form string"


def search_cell(cell: pa.Table) -> pa.Table:
    """The near words of all words of a cell and of those sent there, each pair seen from both sides."""
    words = [w.as_py().encode("latin-1") for w in cell.column("word")]
    n, is_own = cell.column("n").to_numpy(), cell.column("own").to_numpy()
    length = np.fromiter(map(len, words), np.int64, len(words))
    own = np.flatnonzero(is_own)
    gains: list[tuple[np.ndarray, np.ndarray]] = []
    if len(own):
        here = int(length[own[0]])
        point_codes = letters([words[i] for i in own], here)
        points = counts_of(point_codes)
        tree, point_bits = Tree(points, LEAF), thermometer(points)
        sent = np.flatnonzero(~is_own)
        for group in (own, sent[length[sent] == here], sent[length[sent] == here - 1]):
            if len(group):
                codes = letters([words[i] for i in group], int(length[group[0]]))
                for q, p in searched(tree, points, point_bits, point_codes, counts_of(codes), codes):
                    q, p = group[q], own[p]
                    gains.append((q, p))
                    if group is not own:
                        gains.append((p, q))
    word, near = (np.concatenate(x) for x in zip(*gains)) if gains else (np.empty(0, np.int64), np.empty(0, np.int64))
    # The most frequent near word comes first, the least in code points among equals.
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
    seen = np.diff(np.append(first, len(word)))
    of, best = word[first], near[first]
    text = cell.column("word").combine_chunks() if cell.num_rows else pa.array([], pa.string())
    return pa.table({"word": text.take(pa.array(of)), "n_near": pa.array(seen, pa.int64()), "form_n": pa.array(n[best], pa.int64()), "form": text.take(pa.array(best))})


def upper_trees(words: DataFrame) -> dict[int, tuple[Tree, int]]:
    """For each length the upper cuts and the number of its first cell, fitted on a bounded sample."""
    total = words.count()
    share = max(1, -(-total // SAMPLE))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").toPandas()["word"]
    by_length: dict[int, list[bytes]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word.encode("latin-1"))
    trees, first = {}, 0
    for length in sorted(by_length):
        tree = Tree(counts_of(letters(by_length[length], length)), max(1, CELL // share))
        trees[length] = tree, first
        first += len(tree.axis)
    return trees


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form`` of all ``word, n`` that have near words: how many, and the most frequent of them."""
    trees = upper_trees(words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.array([len(w.as_py()) for w in batch.column("word")], np.int64)
            for here in np.unique(length):
                at = np.flatnonzero(length == here)
                codes = letters([batch.column("word")[int(i)].as_py().encode("latin-1") for i in at], int(here))
                counts = counts_of(codes)
                out = []
                home = np.zeros(len(at), np.int64)
                if here in trees:
                    tree, first = trees[here]
                    node = np.zeros(len(at), np.int64)
                    while (tree.axis[node] >= 0).any():
                        inner = tree.axis[node] >= 0
                        low = counts[np.arange(len(at)), np.maximum(tree.axis[node], 0)] <= tree.cut[node]
                        node = np.where(inner, np.where(low, tree.left[node], tree.right[node]), node)
                    home = node
                    query, leaf = tree.reached(counts, True)
                    # Two words of one length meet in the later one's cell.
                    ahead = leaf > home[query]
                    out.append((query[ahead], leaf[ahead]))
                out = [(q, cell, np.zeros(len(q), bool), here) for q, cell in out]
                out.append((np.arange(len(at)), home, np.ones(len(at), bool), here))
                query, leaf = trees[here + 1][0].reached(counts, False) if here + 1 in trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
                out.append((query, leaf, np.zeros(len(query), bool), here + 1))
                for q, cell, own, level in out:
                    if len(q):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(q), level), pa.int64()), pa.array(cell, pa.int64()), pa.array(own), *(batch.column(c).take(pa.array(at[q])) for c in ("word", "n"))], ["length", "cell", "own", "word", "n"]
                        )

    cells = words.select("word", "n").mapInArrow(send, "length bigint, cell bigint, own boolean, word string, n bigint")
    found = cells.groupBy("length", "cell").applyInArrow(search_cell, PARTIAL)
    # Least of the negative count, then of the word: Spark compares strings by code point.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def with_roots(rows: DataFrame) -> DataFrame:
    """Adds ``root``: forms followed to the last one. Each round doubles the steps taken; a form is far more frequent than its
    word, so chains are short and no word comes twice."""
    links = materialise(rows.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links, before = materialise(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms"), links
        if not links.where("moved").limit(1).count():
            return rows.join(before.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        links = links.drop("moved")


def group_spellings(words: DataFrame, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for all rows ``word, n``: a word's form is its most frequent near word, if at least
    ``times`` as frequent."""
    words = materialise(words, "words")
    rows = words.join(near_words(words), "word", "left")
    good = F.col("form_n") >= F.col("n") * times
    rows = rows.select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form_n")).alias("form_n"))
    return with_roots(materialise(rows, "near-words")).select("word", "form", "root", "n", "n_near", "form_n")
