"""What building an index leaves on disk, and indexes whose scopes are spread over many lots."""

import os
import random
import time

import pytest

from tessaly.operators import retrieval, search_index
from tessaly.sources.folders import shared_root

SCHEMA = "owner string, id bigint, chunk_index int, content string"
KEY = ["id", "chunk_index"]
ORDER = ("-id", "-chunk_index")


def some_rows(n, words, seed=3):
    chance = random.Random(seed)
    known = ["".join(chance.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(chance.randint(2, 9))) for _ in range(words)]
    return [(f"o{i % 2}", i // 3, i % 3, " ".join(chance.choice(known) for _ in range(120))) for i in range(n)]


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def stored(spark):
    root = shared_root(spark).removeprefix("file:").replace("///", "/").replace("//", "/")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_building_leaves_the_index_only(spark):
    rows = some_rows(3000, 800)
    size = sum(len(row[3].encode()) for row in rows)
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(8)
    files, shuffles = stored(spark), shuffled(spark)
    index = search_index.build_index(chunks, ["owner"], KEY)
    for _ in range(20):
        left = sum(n for name, n in shuffled(spark).items() if name not in shuffles)
        if left < 0.1 * size:
            break
        time.sleep(0.5)
    new = {name: n for name, n in stored(spark).items() if name not in files}
    assert left < 0.1 * size, (left, size)
    assert sum(n for name, n in new.items() if index.layers[0].removeprefix("file:").lstrip("/") not in name) < 0.1 * size
    assert sum(new.values()) < size


@pytest.mark.parametrize("lot", [1500, 40_000, 10**7])
def test_lots_do_not_change_hits(spark, monkeypatch, lot):
    monkeypatch.setattr(search_index, "LOT_CHARS", lot)
    monkeypatch.setattr(search_index, "BLOCK", 4)
    rows = some_rows(150, 90, seed=4) + [("o0", 900, 0, None), ("o1", 901, 0, "  "), (None, 902, 0, "ab"), ("small", 903, 0, "quite small")]
    chunks = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(i, f"o{i % 2}", " ".join(rows[7 * i][3].split()[:9])) for i in range(12)] + [(50, "small", "smaller"), (51, "o1", "ÉÉ"), (52, "o0", "")], "query_id bigint, owner string, query_text string")
    index = search_index.build_index(chunks, ["owner"], KEY)
    found = lambda frame: sorted((r["query_id"], r["hit_rank"], r["id"], r["chunk_index"], round(r["score"], 8)) for r in frame.collect())
    assert (index.table("chunks").filter("owner = 'o0'").select("block").distinct().count() > 25) == (lot < 10_000)
    mine = found(search_index.search(index, asked, 4, ["query_id"], ORDER))
    assert mine == found(retrieval.search(chunks, asked, 4, ["owner"], KEY, ["query_id"], ORDER))
    sizes = {r["owner"]: r["n_chunks"] for r in index.table("sizes").collect()}
    assert sizes == {"o0": 76, "o1": 76, "small": 1}
    df = {(r["owner"], r["term"]): r["df"] for r in index.table("terms").collect()}
    texts = {}
    for owner, _, _, text in rows:
        if owner:
            texts.setdefault(owner, []).append({f" {w} "[i : i + n] for w in (text or "").lower().split() for n in (2, 3, 4) for i in range(len(w) + 3 - n)})
    assert df == {(owner, term): sum(term in x for x in own) for owner, own in texts.items() for term in set().union(*own)}


def test_small_scopes_leave_no_rows_per_term(spark):
    rows = [(f"o{i // 4}", i, 0, text) for i, (_, _, _, text) in enumerate(some_rows(1200, 500, seed=5))]
    size = sum(len(row[3].encode()) for row in rows)
    asked = spark.createDataFrame([(i, f"o{i}", " ".join(rows[4 * i][3].split()[20:80])) for i in range(300)], "query_id bigint, owner string, query_text string")
    files = stored(spark)
    pairs = retrieval.score_pairs(spark.createDataFrame(rows, SCHEMA).repartition(4), asked, ["owner"], KEY, ["query_id"]).collect()
    assert sum(n for name, n in stored(spark).items() if name not in files) < size
    assert len(pairs) == 1200 and min(max(r["score"] for r in pairs if r["query_id"] == i) for i in (0, 7, 299)) > 0.7


@pytest.mark.parametrize("name", ["r4_rag_context", "j12_context_bundle"])
def test_few_hits_go_to_the_chunks(spark, name):
    import __spark_entry__ as entry

    frame = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "strategy=broadcast" in frame._jdf.queryExecution().optimizedPlan().toString()
