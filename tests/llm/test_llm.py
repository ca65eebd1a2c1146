"""Operators for training text against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessaly.llm import arc_warc, html_blocks, hyperminhash, packing, quality_rules, rule_ensemble, sharding, token_counts, toxicity, winnowing
from tessaly.llm.queries import ORACLES, QUERIES, vocabulary
from tessaly.llm.storage import read_table

SF_DIR = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "one two three four five six seven", "x"), (4, "one two three four five six seven", "x"), (5, "One TWO three four five six seven", "x"),
    (None, "one two three four five six seven", "x"), (6, "İß <|endoftext|> á ## 12 don't", "x"), (7, LONG, "x"), (8, LONG + " end", "x"), (9, "a b", "x"), (10, "A b", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, class string").selectExpr("*", "1 as rep", "'y' as ids", "0 as part", "'z' as row", "2 as bucket", "'q' as words")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in read_table(spark, SF_DIR, "documents").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary())
    return lambda text: coder.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, expected):
    """Pieces tile every document and every window."""
    by_window = defaultdict(list)
    found = Counter()
    for r in rows:
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for number, spans in by_window.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or number == max(by_window)
    docs = defaultdict(list)
    for (doc_id, start, length, crc, total), n in found.items():
        docs[doc_id].append((start, length, crc, total, n))
    for doc_id, lists in expected.items():
        assert sum(length * n for _, length, _, _, n in docs[doc_id]) == sum(map(len, lists))
        for start, length, crc, total, _ in docs[doc_id]:
            assert any(len(ids) == total and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for ids in lists)


def test_packing(spark, texts, ids_of, odd, none):
    check_pieces(QUERIES["op1_packing"](spark, SF_DIR).collect(), {k: [ids_of(t) + [2]] for k, t in texts.items()})
    expected = defaultdict(list)
    for doc_id, text, _ in ODD:
        expected[doc_id].append(ids_of(text) + [2])
    check_pieces(packing.digest(packing.pack(odd, vocabulary())).collect(), expected)
    assert packing.pack(none, vocabulary()).count() == 0


def test_token_counts(spark, texts, ids_of, odd, none, tmp_path):
    plain = __import__("tokenizers").Tokenizer.from_file(vocabulary())
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op3_token_counts"](spark, SF_DIR).collect()}
    assert found == {k: len(plain.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    odd.coalesce(2).write.parquet(str(tmp_path / "odd"))
    stored = spark.read.parquet(str(tmp_path / "odd"))
    rows = token_counts.count_tokens(stored, vocabulary(), docs_a_file=3, block=7).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((k, len(ids_of(t))) for k, t, _ in ODD)
    assert token_counts.count_tokens(none, vocabulary()).count() == 0


def test_token_counts_when_the_table_is_split_otherwise_later(spark, tmp_path):
    docs = [(i if i % 7 else None, "a " * i) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    splits, cost = "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"
    try:
        spark.conf.set(splits, "1")
        counted = token_counts.count_tokens(spark.read.parquet(str(tmp_path / "docs")), vocabulary(), docs_a_file=3)
        spark.conf.set(splits, "8")
        spark.conf.set(cost, "0")
        found = Counter((r["doc_id"], r["n_tokens"]) for r in counted.collect())
    finally:
        spark.conf.unset(splits)
        spark.conf.unset(cost)
    assert found == Counter((i, len(text) // 2) for i, text in docs)


def test_lengths_and_ids_without_partner_fail(spark):
    ids = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id bigint, part bigint, ordinal bigint")
    found = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "part bigint, ordinal bigint, n_tokens bigint")
    assert token_counts.lead_back(ids, found).count() == 2
    for left, right in ((ids.where("doc_id = 1"), found), (ids, found.where("n_tokens = 6"))):
        with pytest.raises(Exception, match="token files and ids differ"):
            token_counts.lead_back(left, right).collect()


def test_open_document_at_the_end_of_a_file(spark, tmp_path):
    (tmp_path / "part-00000-a-c000.txt").write_bytes(np.array([5, 6, 0, 0, 7, 8, 9], "<u2").tobytes())
    for block in (1, 2, 3, 100):
        rows = token_counts.stitch_blocks(token_counts.scan_blocks(spark, str(tmp_path), block)).collect()
        assert sorted((r["ordinal"], r["n_tokens"], r["closed"]) for r in rows) == [(0, 2, True), (1, 0, True), (2, 3, False)]


def plain_counts(text):
    words = BLANK.findall(text)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            doubled += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(inside)


def test_quality_rules(spark, texts, odd, none):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in QUERIES["op4_quality_rules"](spark, SF_DIR).collect():
        expected = plain_counts(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == expected
        assert r["base_failed"] == (expected[0] < 50 or 2 * expected[4] > expected[0])
        assert not (r["base_failed"] and r["kept"])
    rows = quality_rules.judge_documents(odd).collect()
    assert Counter(tuple(r[n] for n in ("doc_id", *names)) for r in rows) == Counter((k, *plain_counts(t or "")) for k, t, _ in ODD)
    assert quality_rules.keep_documents(odd).columns == odd.columns and quality_rules.judge_documents(none).count() == 0
    random = np.random.default_rng(1)
    noise = " ".join("".join(random.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 40)) for _ in range(60))
    prose = next(t for t in texts.values() if t.count(" the ") > 9)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(spark.createDataFrame([(1, noise), (2, prose), (3, "same " * 900)], "doc_id bigint, text string")).collect()}
    assert kept == {1: False, 2: True, 3: False}


def test_the_end_of_a_text_is_judged(spark, texts):
    random = np.random.default_rng(2)
    words = list(dict.fromkeys(" ".join(t for t in texts.values() if t.count(" the ") > 9).split()))
    prose = " ".join(random.choice(words, 900)).encode("ascii", "ignore").decode()[:2048]
    noise = "".join(random.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1989))
    phrase = ("more of the same again and " * 99)[:1989]
    packer = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    assert [quality_rules.count_text(t, packer)[7:] for t in (prose, f"{prose} {noise}", f"{prose} {phrase}", prose[:900], phrase[:900], "")] == [(0, 1), (1, 2), (1, 2), (0, 1), (1, 1), (0, 0)]
    rows = quality_rules.judge_documents(spark.createDataFrame([(1, prose), (2, f"{prose} {noise}")], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["kept"], r["n_chunks"]) for r in rows} == {1: (True, 1), 2: (False, 2)}
    low, high = next((low, high) for below, low, high in quality_rules.BANDS if below and rows[1]["n_bytes"] < below)
    assert low <= rows[1]["ratio"] <= high


def plain_hits(text, items):
    windows = defaultdict(set)
    for item_id, item in items:
        words = PART.findall(lower(item or ""))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add(str(item_id))
    words, hit, found = PART.findall(lower(text or "")), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if (key := tuple(words[i : i + size])) in windows:
                hit |= set(range(i, i + size))
                found |= windows[key]
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("broadcast_rows", [winnowing.BROADCAST_ROWS, 0])
def test_decontamination(spark, texts, odd, none, broadcast_rows):
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF_DIR, "benchmark").collect()]
    rows = winnowing.decontaminate(read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "benchmark"), broadcast_rows=broadcast_rows).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {k: plain_hits(t, items) for k, t in texts.items()}
    short = [(1, None), (2, ""), (3, "three FOUR"), (4, "b"), (5, " ".join(f"w{i}" for i in range(100, 140))), (5, "w7 w8"), (6, "seven"), (7, "w29990 " * 14)]
    table = spark.createDataFrame(short, "item_id bigint, text string")
    rows = winnowing.decontaminate(odd, table, broadcast_rows=broadcast_rows).collect()
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((k, *plain_hits(t, short)) for k, t, _ in ODD)
    kept = winnowing.keep_documents(odd, table, broadcast_rows=broadcast_rows)
    assert kept.columns == odd.columns and kept.count() == sum(not plain_hits(t, short)[4] for _, t, _ in ODD)
    assert winnowing.decontaminate(none, table).count() == 0 and not winnowing.decontaminate(odd, table.where("item_id = -1")).where("n_hit > 0").count()


def test_long_items_keep_small_fingerprints(spark):
    """An item of 3000 words, one that repeats a word, and documents that hold stretches of 12 and 13 of their words."""
    item = [f"w{i % 700}x{i % 11}" for i in range(3000)]
    items = [(1, " ".join(item)), (2, "again " * 500)]
    docs = [(1, " ".join(item[1000:1013])), (2, " ".join(item[1000:1012])), (3, "a b " + " ".join(item[2980:]) + " c"), (4, "again " * 40), (5, " ".join(["z", *item[:14]]))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    known = winnowing.item_fingerprints(table, 5, 13)
    assert known.selectExpr("max(size(near)) AS n").first()["n"] == 21
    for limit in (winnowing.BROADCAST_BYTES, 0):
        rows = winnowing.judged(winnowing.find_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), table, broadcast_bytes=limit), 20).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["item_ids"])) for r in rows} == {k: plain_hits(t, items)[:3] for k, t in docs}


def test_sharding(spark, texts, odd, none):
    rows = QUERIES["op9_sharding"](spark, SF_DIR).collect()
    sums, slots, place = Counter(), defaultdict(list), {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert place.setdefault(text, r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(sums) == 16
    assert max(sums.values()) - min(sums.values()) < 0.02 * max(sums.values())
    for cell_rows, fan_in in ((2, 2), (2, 1000), (1000, 1000)):
        small = sharding.shard_by_bytes(odd, 3, cell_rows, fan_in).collect()
        equal = defaultdict(set)
        for r in small:
            equal[r["text_crc32"]].add(r["shard"])
        assert all(len(found) == 1 for found in equal.values())
        assert Counter(r["doc_id"] for r in small) == Counter(k for k, _, _ in ODD)
        for shard in range(3):
            assert sorted(r["slot"] for r in small if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in small)))
    assert sharding.shard_by_bytes(none).count() == 0


def plain_components(rows):
    """doc_id to (shingles, component) by comparing all pairs that share a shingle."""
    sets, inverted, pairs = {}, defaultdict(set), Counter()
    for doc_id, text in rows:
        words = BLANK.findall(lower(text or ""))
        sets[doc_id] = set(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else {tuple(words)} - {()}
    for doc_id, shingles in sets.items():
        for s in shingles:
            inverted[s].add(doc_id)
    for docs in inverted.values():
        ordered = sorted(docs)
        pairs.update((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :])
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def found_components(frame):
    rows = frame.collect()
    assert all(r["kept"] == (r["component_id"] is None or r["component_id"] == r["doc_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_near_duplicates(spark, texts, odd, none):
    assert found_components(QUERIES["op10_near_duplicates"](spark, SF_DIR)) == plain_components(texts.items())
    known = [(k, t) for k, t, _ in ODD if k is not None]
    assert {k: v for k, v in found_components(hyperminhash.near_duplicates(odd)).items() if k is not None} == plain_components(known)
    assert hyperminhash.keep_documents(odd).columns == odd.columns and hyperminhash.near_duplicates(none).count() == 0


def test_large_group_of_copies_with_changes(spark, monkeypatch):
    """Chains, copies too far from all others and texts that share one passage, with buckets that count as large early."""
    monkeypatch.setattr(hyperminhash, "LARGE_BUCKET", 3)
    random = np.random.default_rng(3)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in random.integers(0, 150, k % 10):
            words[at] = f"n{random.integers(0, 400)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(passage + [f"d{k}x{i}" for i in range(60 + k)])) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_components(hyperminhash.near_duplicates(frame)) == plain_components(rows)


def test_ids_with_several_texts(spark):
    """No text is lost because another one of its id is a copy, and a row counts by its own text."""
    one, two, three = (" ".join(f"{name}{i}" for i in range(40)) for name in "abc")
    rows = [(5, one, "p"), (5, two, "q"), (3, two, "r"), (7, three, "s"), (7, three, "t"), (9, three + " more", "u"), (9, None, "v"), (None, one, "w")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, text_hash string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(frame).where("doc_id is not null").collect())
    assert found == [(3, 36, 3, True), (5, 36, 3, False), (5, 36, 5, True), (7, 36, 7, True), (7, 36, 7, True), (9, 0, 9, True), (9, 37, 7, False)]
    assert sorted(r["text_hash"] for r in hyperminhash.keep_documents(frame).collect()) == ["p", "r", "s", "t", "v", "w"]


def test_centres_of_many_pairs_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "HOT_PAIRS", 3)
    monkeypatch.setattr(hyperminhash, "BROADCAST_IDS", 0)
    base = [f"b{i}" for i in range(150)]
    rows = [(k, " ".join(base[:k] + [f"n{k}"] + base[k + 1 :])) for k in range(60)] + [(100 + k, f"other text {k} of its own with words {k}") for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_components(hyperminhash.near_duplicates(frame)) == plain_components(rows)
    pairs = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, 60) for k in range(60)], "a bigint, b bigint")
    hot = {r["hot"]: r["parts"] for r in hyperminhash.hot_classes(pairs).collect()}
    assert hot == {0: 20, 60: 20}


def test_archives(spark, odd, none):
    pages = [(1, "http://a/ b", "x" * 1000), (2, None, "x" * 1000), (3, "", None), (4, "http://c", "é\n\nWARC/1.1\r\n\r\n" * 90), (5, "http://d", "short"), (6, "http://d", "short"), (9, "u", "x" * 1000), (None, "v", "x" * 1000)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("record_id", __import__("pyspark").sql.functions.lit(1)).repartition(3)
    rows = {r["page_id"]: r for r in arc_warc.archive_pages(frame).collect()}
    assert len(rows) == len(pages)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and html == "x" * 1000 and page_id != 9
        assert (rows[page_id]["payload_bytes"], rows[page_id]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (rows[page_id]["record_type"], rows[page_id]["refers_to"]) == (("revisit", 9) if again else ("response", None))
    assert arc_warc.archive_pages(frame.where("page_id = -1")).count() == 0
    assert QUERIES["op6_arc_to_warc"](spark, SF_DIR).count() == read_table(spark, SF_DIR, "pages").count()


def test_main_text(spark):
    for r in QUERIES["op5_main_text"](spark, SF_DIR).join(read_table(spark, SF_DIR, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(__import__("html").unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    pages = [
        (1, None), (2, ""), (3, "<p>"), (4, "just text without any element, but long enough to be taken for the text of a page by anybody who reads it"),
        (5, '<header>Top</header><div class="sidebar"><p>side text that is rather long and full of words</p></div><article><h1>T &amp; U</h1><p>a&nbsp;b\n c <script>var x = "</p>";</script>d<p>e</article><div id="comments"><p>I liked reading this</p></div><!-- <p>no</p>'),
    ]
    found = {r["page_id"]: r["text"] for r in html_blocks.main_text(spark.createDataFrame(pages, "page_id bigint, html string").selectExpr("page_id", "'u' as url", "html", "1 as blocks")).collect()}
    assert found[1] == found[2] == found[3] == "" and found[5] == "T & U\n\na b c d\n\ne" and found[4].startswith("just text")


def test_words_of_headings_and_sections_are_no_asides(spark):
    pages = [
        (1, '<article><div class="post-header"><h1>The title</h1></div><h2 id="how-to-register">How to register</h2><p>Go there.</p><h2 id="search-results" class="section-header">Search results</h2><ul><li id="reply-to-smith">Point</li></ul></article>'),
        (2, '<article><h1>A</h1><section id="related-work"><h2>Related work</h2><p>Others did it.</p></section><section id="discussion"><p>We see it so.</p></section><section id="comments"><h3>2 Comments</h3><p>I read it with joy.</p></section>'
            '<section id="related"><p><a href="/a">Another page about it</a></p></section><div id="sidebar"><p>Side text.</p></div><p>End.</p></article>'),
        (3, '<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, and <object data="a.svg">a drawing</object> follows.</p></article>'),
        (4, '<article><p>Text of the page that is long enough.</p></article><div id="site-header"><p>The daily page</p></div><div id="main-nav"><p>News of today</p></div>'),
    ]
    found = {r["page_id"]: r["text"].split("\n\n") for r in html_blocks.main_text(spark.createDataFrame(pages, "page_id bigint, html string").selectExpr("page_id", "'u' as url", "html")).collect()}
    assert found == {
        1: ["The title", "How to register", "Go there.", "Search results", "Point"], 2: ["A", "Related work", "Others did it.", "We see it so.", "End."],
        3: ["Where x=2 holds, and a drawing follows."], 4: ["Text of the page that is long enough."],
    }


@pytest.mark.parametrize(("module", "label", "query"), [(toxicity, "toxic", "op2_toxicity"), (rule_ensemble, "quality", "op7_quality_classifier")])
def test_classifiers(spark, odd, none, module, label, query):
    rows = QUERIES[query](spark, "/root/testdata/sf0.01").join(read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in rows) == len(held)
    assert sum(r["predicted"] == r[label] for r in held) >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    empty = read_table(spark, SF_DIR, "labels").where("doc_id = -1")
    scored = module.score_documents(odd, empty).collect()
    assert Counter(r["doc_id"] for r in scored) == Counter(k for k, _, _ in ODD) and all(r["score"] == 0 for r in scored)
    assert module.score_documents(none, read_table(spark, SF_DIR, "labels")).count() == 0


def test_rules_say_what_their_column_says(spark):
    packer = rule_ensemble.zstandard.ZstdCompressor()
    frame = rule_ensemble.with_statistics(spark.createDataFrame([(1, "Some words. #1"), (2, None)], "doc_id bigint, text string"))
    rule = (("n_words", ">", 2.0), ("symbols", ">", 0.01))
    assert {r["doc_id"]: r["c"] for r in frame.select("doc_id", rule_ensemble.condition(rule).alias("c")).collect()} == {1: True, 2: False}
    assert len(rule_ensemble.statistics_of("x", packer)) == len(rule_ensemble.STATISTICS)


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    labels = read_table(spark, SF_DIR, "labels")
    assert toxicity.keep_documents(odd, labels).columns == odd.columns
    assert toxicity.keep_documents(none, labels).count() == 0
    for name, rows in (("odd", odd), ("none", none)):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            read_table(spark, SF_DIR, table).write.parquet(f"{folder}/{table}.parquet")
        docs = read_table(spark, folder, "documents")
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, folder)
            assert kept.columns == docs.columns
        pieces = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "sequence_id", "offset"} <= set(pieces.columns)
        assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in kept.collect()}


def test_identifiers_that_do_not_fit_fail(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "LARGEST_ID", 5)
    with pytest.raises(Exception, match="identifiers up to 5"):
        token_counts.count_tokens(odd, vocabulary()).collect()


def test_disguised_words_count():
    words = toxicity.text_features("you 1d1ot", frozenset({"idiot"}), frozenset())
    assert dict(zip(toxicity.FEATURES, toxicity.text_features("you idiot", frozenset({"idiot"}), frozenset()), strict=True))["near_you"] == 1
    assert len(words) == len(toxicity.FEATURES)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read_table(spark, SF_DIR, "documents")
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF_DIR, "benchmark").collect()]

    def compressible(text):
        judged = quality_rules.count_text(text, quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL))
        low, high = next((low, high) for below, low, high in quality_rules.BANDS if below is None or judged[5] < below)
        return low <= judged[6] <= high and judged[7] <= quality_rules.ODD_CHUNKS * judged[8]

    def good(text):
        words, _, _, _, repeated = plain_counts(text)
        return words >= 50 and 2 * repeated <= words and compressible(text)

    expected = {
        "quality rules": lambda rows: {k for k, t in rows.items() if good(t)},
        "near duplicates": lambda rows: {k for k, (_, root) in plain_components(rows.items()).items() if k == root},
        "decontamination": lambda rows: {k for k, t in rows.items() if not plain_hits(t, items)[4]},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns
        docs = corpus_pipeline.materialise(kept, "stage")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name in expected:
            assert after == expected[name](before), name
        else:
            scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_toxicity"](spark, SF_DIR).collect()}
            assert after == {k for k in before if not scores[k]}
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert set(ORACLES) <= set(QUERIES)
