"""Retrieval, memory, recommendation, segmented windows and streams on small inputs."""

import hashlib
import json
import math
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessaly.operators import jobs as J
from tessaly.operators import memory as M
from tessaly.operators import recommend as R
from tessaly.operators import retrieval, segmented
from tessaly.sources import corpus, sinks
from tessaly.streaming import jobs as S


def grams(text):
    counted = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        counted.update(padded[i:i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1))
    return counted


def cosine(corpus_texts, question):
    """Scores of a vectorizer refitted on corpus and question."""
    rows = [grams(t) for t in [*corpus_texts, question]]
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in r for r in rows))) + 1 for r in rows for t in r}
    vectors = [{t: n * idf[t] for t, n in r.items()} for r in rows]
    length = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
    return [sum(x * vectors[-1].get(t, 0) for t, x in v.items()) / (n * length[-1]) for v, n in zip(vectors[:-1], length)]


def test_search_equals_refitted_model(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "éa", "线性模型", "x", "delta-9"]
    chunks = [(s, i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for s, n in (("a", 40), ("b", 3)) for i in range(n)]
    asked = [("a", 1, "alpha 线性"), ("a", 2, "zzzz"), ("b", 3, "Gamma x"), ("c", 4, "alpha")]
    got = retrieval.search(
        spark.createDataFrame(chunks, "owner string, id int, content string"),
        spark.createDataFrame(asked, "owner string, query_id int, query_text string"), 5, ["owner"], ["id"], ["query_id"], ("-id",),
    ).collect()
    for owner, query_id, question in asked:
        mine = [(c[1], c[2]) for c in chunks if c[0] == owner]
        scores = cosine([t for _, t in mine], question)
        want = sorted(((round(s, 10), i) for (i, _), s in zip(mine, scores)), reverse=True)[:5]
        have = sorted((r.hit_rank, r.id, r.score) for r in got if r.query_id == query_id)
        assert [i for _, i, _ in have] == [i for _, i in want]
        assert all(abs(h[2] - w[0]) < 1e-9 for h, w in zip(have, want))


def test_segmented_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    # One key holds most rows.
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(0, 400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").withColumn("seg", F.floor(F.col("v") / 50))
    w = Window.partitionBy("k").orderBy("v", "i")
    plain = df.select(
        "i", F.row_number().over(w).alias("r"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.lag("i").over(w).alias("lag"), F.lead("i").over(w).alias("lead"),
    )
    out = segmented.ranked(df, ["k"], "seg", [F.col("v"), F.col("i")], "r")
    out = segmented.running_sum(out, ["k"], "seg", [F.col("v"), F.col("i")], F.col("v"), "s")
    out = segmented.neighbour(out, ["k"], "seg", ["v", "i"], "i", "lag", -1)
    out = segmented.neighbour(out, ["k"], "seg", ["v", "i"], "i", "lead", 1)
    assert out.select("i", "r", "s", "lag", "lead").exceptAll(plain).count() == 0


def test_key_totals(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 3, 4), ("b", 3, 8)], "k string, seg int, v int")
    got = segmented.key_totals(rows, ["k"], "seg", {"total": F.col("v")}).collect()
    assert sorted((r.k, r.seg, r.v, r.total) for r in got) == [("a", 0, 1, 7), ("a", 0, 2, 7), ("a", 3, 4, 7), ("b", 3, 8, 8)]


def test_latest_at(spark):
    steps = spark.createDataFrame([("a", p, p * 10) for p in (3, 70, 71, 300)], "k string, p int, v int").withColumn("seg", F.floor(F.col("p") / 50))
    probes = spark.createDataFrame([("a", q, q) for q in (1, 3, 69, 70, 299, 1000)] + [("b", 5, 5)], "k string, p int, q int").withColumn("seg", F.floor(F.col("p") / 50))
    got = {(r.k, r.q): r.v for r in segmented.latest_at(probes, steps, ["k"], "seg", "p", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 3): 30, ("a", 69): 30, ("a", 70): 700, ("a", 299): 710, ("a", 1000): 3000, ("b", 5): None}


def memory_events(spark, *rows):
    full = [(1, n, t, c, i, 1000 + n) for n, (t, c, i) in enumerate(rows)]
    return spark.createDataFrame(full, "user_id bigint, seq int, memory_type string, content string, importance int, epoch bigint")


def test_conflicting_preferences_update_one_row(spark):
    events = memory_events(
        spark, ("food_preference", "饮食偏好：不吃辣", 4), ("food_preference", "饮食偏好：喜欢辣", 2), ("user", " 喜欢早起 ", 9), ("user", "喜欢 早起", 1), ("user", "  ", 5)
    )
    rows = M.fold_memories(events).orderBy("id").collect()
    assert [(r.id, r.memory_key, r.content, r.importance, r.updated_at) for r in rows] == [
        (0, "food:spicy", "饮食偏好：喜欢辣", 4, 1001), (2, None, "喜欢 早起", 5, 1003)
    ]
    halves = M.partial_fold(events.filter("seq < 2")).unionByName(M.partial_fold(events.filter("seq >= 1")))
    assert M.merge_folds(halves).exceptAll(M.fold_memories(events)).count() == 0


def one_by_one(events):
    """Memories by applying events in turn: the rule itself."""
    rows = []
    for user, seq, key, text, importance in sorted(events, key=lambda e: e[1]):
        same = [r for r in rows if r["user"] == user and (r["key"] == key if key else r["text"] == text)]
        target = max(same, key=lambda r: r["id"], default={"id": seq, "created": seq, "importance": 0})
        rows = [r for r in rows if r not in same]
        rows.append({**target, "user": user, "key": key, "text": text, "importance": max(importance, target["importance"]), "updated": seq})
    return [(r["user"], r["id"], r["key"], r["text"], r["importance"], r["created"], r["updated"]) for r in rows]


def test_memories_of_mixed_types(spark):
    """Texts with and without a key in any order; segments shorter than the gaps between clears."""
    draw, events, rows = random.Random(5), [], []
    for seq in range(1200):
        user, name, keyed, importance = draw.randrange(60), draw.choice(["辣", "不辣", "10元", "20元", "面"]), draw.random() < 0.5, draw.randint(1, 5)
        text = {"辣": "想吃辣", "不辣": "不吃辣", "10元": "预算10元", "20元": "预算20元", "面": "喜欢面"}[name]
        key = {"辣": "food:spicy", "不辣": "food:spicy", "10元": "food:budget", "20元": "food:budget", "面": "food:like:面"}[name] if keyed else None
        rows.append((user, seq, "food_preference" if keyed else "user", text, importance, seq))
        events.append((user, seq, key, text, importance))
    given = spark.createDataFrame(rows, "user_id bigint, seq bigint, memory_type string, content string, importance int, epoch bigint")
    keys = {r.memory_key for r in given.select(M.infer_key("memory_type", "content").alias("memory_key")).distinct().collect()}
    assert keys == {None, "food:spicy", "food:budget", "food:like:面"}
    got = M.fold_memories_in_order(given, segment_events=50).collect()
    assert sorted(((r.user_id, r.id, r.memory_key, r.content, r.importance, r.created_at, r.updated_at) for r in got), key=str) == sorted(one_by_one(events), key=str)


def test_relevant_memory_ranks_first(spark):
    rows = M.fold_memories(memory_events(spark, ("user", "偏好早晨学习数学", 3), ("user", "喜欢用表格整理论文", 3)))
    asked = spark.createDataFrame([(1, "论文 表格")], "user_id bigint, query_text string")
    assert M.rank_memories(rows, 1, asked).first().content == "喜欢用表格整理论文"


def test_blank_question_ranks_without_relevance(spark):
    rows = M.fold_memories(memory_events(spark, ("user", "偏好早晨学习数学", 3), ("user", "喜欢用表格整理论文", 5)))
    blank = spark.createDataFrame([(1, " ")], "user_id bigint, query_text string")
    columns = ["user_id", "id", "memory_rank", "relevance_score"]
    assert M.rank_memories(rows, 2, blank).select(columns).collect() == M.rank_memories(rows, 2).select(columns).collect()


def catalogue(spark, rows):
    base = dict(enabled=True, meal_times=["午餐"], tastes=["清淡"], categories=["米饭"], suitable_for=[], distance=5, text="dish")
    schema = ("id bigint, price double, weight double, enabled boolean, meal_times array<string>, tastes array<string>, categories array<string>, "
              "suitable_for array<string>, distance int, text string")
    names = [s.split()[0] for s in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schema)


def requested(spark, rows):
    base = dict(budget=None, remembered_budget=None, meal=None, max_distance=None, category=None, taste=None, group_size=None, avoid=[], liked=[], excluded=[])
    schema = ("request_id bigint, budget double, remembered_budget double, meal string, max_distance int, category string, taste string, group_size int, "
              "avoid array<string>, liked array<string>, excluded array<bigint>")
    names = [s.split()[0] for s in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schema)


def test_cascade_blockers_and_draw(spark):
    dishes = catalogue(spark, [
        dict(id=1, price=10.0, weight=1.0), dict(id=2, price=20.0, weight=3.0, text="spicy 辣"), dict(id=3, price=30.0, weight=6.0, enabled=False),
    ])
    asked = requested(spark, [
        dict(request_id=1), dict(request_id=2, budget=5.0), dict(request_id=3, meal="早餐"), dict(request_id=4, avoid=["DISH", "spicy"]),
        dict(request_id=5, excluded=[1]), dict(request_id=6, taste="不吃辣", budget=20.0), dict(request_id=7, excluded=[1, 2]),
    ])
    shaped = R.shaped_requests(asked, "canteen")
    steps = R.cumulative(R.stage_rows(dishes, shaped, "canteen"))
    counted = R.stage_counts(shaped, steps)
    blockers = {r.request_id: r.b for r in counted.select("request_id", R.first_blocker(counted, "canteen").alias("b")).collect()}
    assert blockers == {1: None, 2: "budget", 3: "first", 4: "avoid", 5: None, 6: None, 7: "default"}
    picks = {r.request_id: r.id for r in R.weighted_pick(shaped, steps, counted, "s").collect()}
    assert set(picks) == {1, 5, 6} and picks[5] == 2 and picks[6] == 1


def test_draws_follow_the_weights(spark):
    dishes = catalogue(spark, [dict(id=i, price=10.0 + i, weight=float(w)) for i, w in enumerate((1, 2, 3, 4))])
    shaped = R.shaped_requests(requested(spark, [dict(request_id=i, excluded=[2]) for i in range(4000)]), "canteen")
    steps = R.cumulative(R.stage_rows(dishes, shaped, "canteen"))
    drawn = R.weighted_pick(shaped, steps, R.stage_counts(shaped, steps), "seed").groupBy("id").count().collect()
    seen = {r.id: r["count"] for r in drawn}
    expected = {0: 4000 / 7, 1: 8000 / 7, 3: 16000 / 7}
    assert set(seen) == set(expected)
    assert sum((seen[i] - e) ** 2 / e for i, e in expected.items()) < 13.8  # 0.1 % point, 2 degrees


def test_every_place_of_a_large_weight_can_be_drawn(spark):
    total = 1 << 50
    number = int(hashlib.md5(b"s|1").hexdigest()[:15], 16)
    place = number * total >> 60
    assert place != (number >> 28) * total >> 32
    shaped = spark.createDataFrame([(1, ["", "", "", "", "", "", "", "7a"])], "request_id bigint, keys array<string>")
    steps = spark.createDataFrame([("7a", 1, place, place), ("7a", 2, 1, place + 1), ("7a", 3, total - place - 1, total)], "key string, id bigint, units bigint, units_to bigint")
    counted = spark.createDataFrame([(1, total, None)], "request_id bigint, total_units bigint, intervals array<struct<start:bigint,units:bigint>>")
    assert [r["id"] for r in R.weighted_pick(shaped, steps, counted, "s").collect()] == [2]


def test_bitmaps_equal_every_request_against_every_dish(spark):
    """Each request has words of its own; prices tie or are unknown, weights are missing or below zero, words are empty or null."""
    draw = random.Random(5)
    syllables = ["ka", "ro", "mi", "辣", "te", "Su", "é"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))
    dishes = [
        dict(id=i * 7 % 601, price=draw.choice([None, 10.0, 10.004, draw.randint(0, 400) / 8]), weight=draw.choice([None, 0.0, 1.0, 2.5, -1.0, -3.25]),
             enabled=draw.random() < 0.95, meal_times=draw.sample(["早餐", "午餐", "晚餐"], draw.randint(0, 3)), tastes=[word() for _ in range(draw.randint(0, 2))],
             categories=[draw.choice(["米饭", "粉"])], text=" ".join([word(), word(), "米饭"][: draw.randint(0, 3)]).lower())
        for i in range(601)
    ]
    asks = [
        dict(request_id=i, budget=draw.choice([None, 0.0, 10.0, 10.002, 33.3, 900.0]), meal=draw.choice([None, "随便", "午餐"]), category=draw.choice([None, "米饭", "none"]),
             taste=draw.choice([None, "不吃辣", "想吃ka", "mi"]), avoid=[f"own{i}", word(), None][: draw.randint(0, 3)] + [""] * (i == 3),
             liked=[word(), f"like{i}"][: draw.randint(0, 2)], excluded=draw.sample(range(601), draw.randint(0, 40)))
        for i in range(50)
    ]
    shaped = R.shaped_requests(requested(spark, asks), "canteen")
    steps = R.cumulative(R.stage_rows(catalogue(spark, dishes), shaped, "canteen"))
    counted = R.stage_counts(shaped, steps)
    got = {r.request_id: r for r in counted.collect()}
    picks = {r.request_id: (r.id, r.units) for r in R.weighted_pick(shaped, steps, counted, "s").collect()}
    some = 0
    for ask in asks:
        free = lambda v, *also: v in (None, "", "随机", "随便", *also)
        rows = sorted((d for d in dishes if d["enabled"] and d["id"] not in ask["excluded"]), key=lambda d: (math.inf if d["price"] is None else d["price"], d["id"]))
        mild = ask["taste"] == "不吃辣"
        tests = [
            lambda d: ask["budget"] is None or (d["price"] is not None and d["price"] <= ask["budget"]),
            lambda d: free(ask["meal"]) or ask["meal"] in d["meal_times"], lambda d: free(ask["category"]) or ask["category"] in d["categories"],
            lambda d: free(ask["taste"], "不吃辣") or ask["taste"] in d["tastes"], lambda d: True,
            lambda d: not any(w.lower() in d["text"] for w in ask["avoid"] if w is not None), lambda d: not (mild and "辣" in d["text"]),
        ]
        left = [len(rows)]
        for test in tests:
            rows = [d for d in rows if test(d)]
            left.append(len(rows))

        def units(d):
            taste = 100 if mild else 200 * (not free(ask["taste"]) and ask["taste"].replace("想吃", "") in d["text"])
            category = 200 * (not free(ask["category"]) and ask["category"] in d["text"])
            return max(1, round((d["weight"] or 1.0) * 100) + taste + category + 150 * any(w.lower() in d["text"] for w in ask["liked"]))

        row, total = got[ask["request_id"]], sum(map(units, rows))
        assert [row[f"n_{name}"] for name in R.STAGES] == left and (row.total_units or 0) == total
        if total:
            some += 1
            place = int(hashlib.md5(f"s|{ask['request_id']}".encode()).hexdigest()[:15], 16) * total >> 60
            for d in rows:
                if place < units(d):
                    assert picks[ask["request_id"]] == (d["id"], units(d))
                    break
                place -= units(d)
    assert len(picks) == some > 10
    # A row holds up to 64 candidates.
    assert steps.rows.count() < 601 * 50


def test_empty_catalogue_has_no_candidates(spark):
    shaped = R.shaped_requests(requested(spark, [dict(request_id=1, avoid=["a"])]), "canteen")
    steps = R.cumulative(R.stage_rows(catalogue(spark, []), shaped, "canteen"))
    counted = R.stage_counts(shaped, steps)
    assert [(r.n_enabled, r.n_no_spice, r.total_units) for r in counted.collect()] == [(0, 0, 0)]
    assert R.weighted_pick(shaped, steps, counted, "s").count() == 0


def test_restaurant_budget(spark):
    places = catalogue(spark, [dict(id=1, price=25.0, weight=1.0), dict(id=2, price=60.0, weight=1.0, suitable_for=["聚餐"], distance=30)])
    asked = requested(spark, [dict(request_id=1, budget=30.0), dict(request_id=2, max_distance=10), dict(request_id=3, group_size=1), dict(request_id=4, remembered_budget=5.0)])
    shaped = R.shaped_requests(asked, "restaurant")
    counted = R.stage_counts(shaped, R.cumulative(R.stage_rows(places, shaped, "restaurant")))
    assert {r.request_id: r.n_no_spice for r in counted.collect()} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_budgets_are_strict_and_ids_may_be_names(spark):
    """A price of a fraction of a cent above the budget is too dear; ids of dishes are strings; every request avoids words of its own."""
    priced = [("soup", 10.004), ("rice", 10.0), ("zucchini", 9.999), ("tea", None), ("air", 0.0), ("Äpfel", 10.0)]
    dishes = catalogue(spark, [dict(id=k, price=price, weight=1.0, text=f"dish {name.lower()}") for k, (name, price) in enumerate(priced)])
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(priced)], "id bigint, name string")
    dishes = dishes.join(names, "id").drop("id").withColumnRenamed("name", "id")
    asked = requested(spark, [
        dict(request_id=1, budget=10.0), dict(request_id=2, budget=10.004), dict(request_id=3, budget=0.0), dict(request_id=4), dict(request_id=5, budget=9.9995),
        *(dict(request_id=10 + k, budget=10.0, avoid=[name.lower(), f"word{k}"]) for k, (name, _) in enumerate(priced)),
    ]).drop("excluded").withColumn("excluded", F.when(F.col("request_id") == 4, F.array(F.lit("tea"), F.lit("tea"))).otherwise(F.array().cast("array<string>")))
    shaped = R.shaped_requests(asked, "canteen")
    steps = R.cumulative(R.stage_rows(dishes, shaped, "canteen"))
    counted = R.stage_counts(shaped, steps)
    left = {r.request_id: r.n_no_spice for r in counted.collect()}
    assert left == {1: 4, 2: 5, 3: 1, 4: 5, 5: 2, 10: 4, 11: 3, 12: 3, 13: 4, 14: 3, 15: 3}
    picks = {r.request_id: r.id for r in R.weighted_pick(shaped, steps, counted, "s").collect()}
    assert picks[3] == "air" and picks[1] in {"rice", "zucchini", "air", "Äpfel"} and picks[5] in {"zucchini", "air"} and set(picks) == set(left)


def test_request_phrases(spark):
    texts = ["我不想出门，帮我点个外卖", "附近人均 40 以内，三个人聚餐", "食堂午饭吃什么，20块，不辣"]
    rows = R.parse_requests(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.mode for r in rows] == ["takeaway", "restaurant", "canteen"]
    assert (rows[1].budget, rows[1].group_size, rows[2].budget, rows[2].taste, rows[2].meal_time) == (40, 3, 20, "不吃辣", "午餐")


def test_retry_delays(spark):
    rows = spark.createDataFrame([(1,), (2,), (20,)], "n int").select(J.retry_delay(F.col("n"))).collect()
    assert [r[0] for r in rows] == [5, 10, 300]


def test_stale_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, "running"), (1, 60, "running"), (1, 135, "running"), (1, 300, "completed"), (2, 10, "running"), (2, 400, "queued"), (3, 5, "completed"), (3, 500, "running"), (9, 9000, "queued"), (8, 9000, "running")]
    events = spark.createDataFrame(
        [(j, i, 1_700_000_000 + t, s, i == 4) for i, (j, t, s) in enumerate(rows)], "job_id bigint, event_id bigint, t bigint, status string, cancel_requested boolean"
    ).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    now = F.timestamp_seconds(F.lit(1_700_009_000 + 300))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in*"))
    got = {(r.job_id, r.event_id, r.status) for r in S.stale_heartbeats(stream, str(tmp_path / "out"), now, "0 seconds").collect()}
    batch = {(r.job_id, r.event_id, r.status) for r in J.stale_gaps(events, now).collect()}
    assert batch == {(1, 2, "queued"), (2, 4, "cancelled"), (3, 7, "queued"), (8, 9, "queued")}  # jobs 3 and 8 are silent since
    assert got == batch


def test_open_groups_are_kept_over_runs(spark, tmp_path):
    """Each run of a stream over the same folder returns all groups, whether closed before, closed now or open."""
    def arrive(name, rows):
        events = spark.createDataFrame(rows, "job_id bigint, event_id bigint, t bigint, status string, cancel_requested boolean, event_type string")
        events.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        return spark.read.parquet(f"{tmp_path}/in/*")

    day, base = 86_400, 1_700_000_000

    def compare(events):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        sessions = S.heartbeat_sessions(stream, f"{tmp_path}/sessions", 3600)
        batch = J.activity_sessions(events, 3600).select("job_id", "started_at", "last_at", "events")
        assert sorted(sessions.drop("open").collect()) == sorted(batch.collect())
        weeks = S.weekly_refresh_windows(stream, f"{tmp_path}/weeks")
        expected = events.groupBy("event_type", F.window("ts", "7 days")).count().select("event_type", "window.start", "count")
        assert sorted(weeks.drop("open").collect()) == sorted(expected.collect())
        return sessions.filter("open").count(), weeks.filter("open").count()

    assert compare(arrive("a", [(1, 1, base, "running", False, "x"), (1, 2, base + 60, "running", False, "x"), (2, 3, base + 90, "queued", False, "y")])) == (2, 2)
    # Job 1 goes on in its open session; two weeks later job 2 starts another one and closes what stood open.
    later = [(1, 4, base + 120, "running", False, "x"), (2, 5, base + 14 * day, "queued", False, "y")]
    assert compare(arrive("b", later)) == (1, 1)


def test_first_arrival_of_a_content(spark, tmp_path):
    """Of equal texts the one that arrived first is taken, the smallest id of ties, whatever file it lies in."""
    rows = [(5, "same", 10), (9, "same", 5), (7, "same", 5), (2, "other", 3), (1, "other", 4), (4, None, 1), (3, "", 1)]
    docs = spark.createDataFrame(rows, "id bigint, body string, t bigint").withColumn("arrived_at", F.timestamp_seconds("t")).drop("t")
    for i in range(3):
        docs.filter(F.col("id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    firsts = S.first_arrivals(stream, f"{tmp_path}/out")
    assert {r.id for r in firsts.collect()} == {7, 2, 4, 3}
    chunks = S.ingested_chunks(firsts, docs.select("id", "body"), 3, 0)
    assert {(r.id, r.chunk_index, r.content) for r in chunks.collect()} == {(7, 0, "sam"), (7, 1, "e"), (2, 0, "oth"), (2, 1, "er")}


def test_text_corpus_and_catalogue(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é\r\nb".encode() + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    texts, rejects = corpus.read_text_corpus(spark, str(tmp_path))
    assert texts.first().text == "é\nb" and rejects.first().error.endswith(".pdf")
    (tmp_path / "c.json").write_text('{"schema_version": 2, "restaurants": [{"name": "r1"}]}')
    (tmp_path / "d.json").write_text('{"restaurants": [')
    records, errors = corpus.read_catalogue(spark, str(tmp_path / "c.json"), str(tmp_path / "d.json"))
    assert records.count() == 1 and errors.first().path.endswith("d.json")


def test_catalogue_keeps_every_field_and_collection(spark):
    text = json.dumps({
        "canteen_dishes": [{"id": "c", "window": "3", "floor": "2"}],
        "restaurants": [{"id": "r", "area": "near", "recommended_food": "noodles", "distance_minutes": 8, "suitable_for": ["one", "two"]}, {"id": "r2", "distance_minutes": "9", "suitable_for": "one"}],
        "takeaways": [{"id": "t", "platforms": ["p"], "delivery_minutes": 30}],
        "pending_review": [{"id": "p", "name": "n", "record_type": "restaurant", "source_snippet": "s", "status": "pending"}], "sources": [{"title": "w", "url": "u", "snippet": "x", "query": "q"}, "http://a"],
    })
    records, errors = corpus.parse_catalogue(spark.createDataFrame([(text,)], "value string"))
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in records.collect()]
    assert errors.count() == 0 and sorted(rows, key=str) == sorted([
        {"collection": "canteen_dishes", "id": "c", "window": "3", "floor": "2"},
        {"collection": "restaurants", "id": "r", "area": "near", "recommended_food": "noodles", "distance_minutes": 8.0, "suitable_for": ["one", "two"]},
        {"collection": "restaurants", "id": "r2", "distance_minutes": 9.0, "suitable_for": ["one"]}, {"collection": "takeaways", "id": "t", "platforms": ["p"], "delivery_minutes": 30.0},
        {"collection": "pending_review", "id": "p", "name": "n", "record_type": "restaurant", "source_snippet": "s", "status": "pending"},
        {"collection": "sources", "name": "w", "source_url": "u", "source_snippet": "x", "query": "q"}, {"collection": "sources", "source_url": "http://a"},
    ], key=str)


def test_replacing_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    old = spark.range(100).select("id", F.lit("old").alias("v"))
    sinks.save_replaced(old, path, ["id"], 8)
    stored, changed = spark.read.parquet(path), spark.createDataFrame([(7,)], "id bigint")
    touched = sinks.touched_buckets(stored, changed, ["id"], 8).drop("key_bucket")
    assert touched.count() < 60
    sinks.save_replaced(sinks.write_replace(touched, changed.withColumn("v", F.lit("new")), changed, ["id"]), path, ["id"], 8)
    spark.catalog.refreshByPath(path)
    assert {r.v: r["count"] for r in spark.read.parquet(path).groupBy("v").count().collect()} == {"old": 99, "new": 1}


def test_a_stream_reads_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(20).selectExpr("id AS doc")
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "many.parquet"))
    rows.toPandas().to_parquet(tmp_path / "in" / "one.parquet")
    for name in ("many.parquet", "one.parquet"):
        arrived = S.run_append(S.file_stream(spark, str(tmp_path / "in"), name, rows.schema, 1), str(tmp_path / f"out-{name}"))
        assert sorted(r.doc for r in arrived.collect()) == list(range(20))


def test_texts_are_not_sent_to_the_words(spark, monkeypatch):
    texts = ["red bolt", "cold ring", "small plate", "", "red ring"]
    ordered = spark.createDataFrame([(0, 1 << i, t) for i, t in enumerate(texts)], "block bigint, bit bigint, text string")
    words = spark.createDataFrame([("ring",), ("re",), ("late",), ("absent",)], "word string")
    joins = []
    for most in (R.SENT_WORDS, 1):
        monkeypatch.setattr(R, "SENT_WORDS", most)
        found = R.word_bitmaps(ordered, words)
        joins.append(found._jdf.queryExecution().executedPlan().toString())
        assert {r.word: r.bits for r in found.collect()} == {"ring": 0b10010, "re": 0b10001, "late": 0b100}
    assert "BuildRight" in joins[0] and "BuildLeft" not in joins[0]
    assert "SortMergeJoin" in joins[1] and "BroadcastHashJoin" not in joins[1]
