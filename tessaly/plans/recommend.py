"""Recommendation queries: customers ask, parts are the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.operators import recommend as R
from tessaly.plans.registry import query
from tessaly.plans.views import strip_sql, view, view_sql
from tessaly.session import table
from tessaly.sources.folders import materialise
from tessaly.sources.migration import migrate_catalogue

MEALS = "CASE id % 3 WHEN 0 THEN {a}'午餐'{z} WHEN 1 THEN {a}'早餐', '晚餐'{z} ELSE {a}'午餐', '晚餐'{z} END"
FITS = "CASE id % 4 WHEN 1 THEN {a}'一人食'{z} WHEN 2 THEN {a}'两人', '聚餐'{z} WHEN 3 THEN {a}'聚餐'{z} ELSE {e} END"
REQUEST = {
    "request_id": "c_custkey",
    "budget": "CASE WHEN c_custkey % 20 = 0 THEN 5 WHEN c_custkey % 11 = 0 THEN NULL ELSE 900 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 100 END",
    "remembered_budget": "CASE WHEN c_custkey % 22 = 0 THEN 930 END",
    "meal": "CASE c_custkey % 5 WHEN 0 THEN '早餐' WHEN 1 THEN '午餐' WHEN 2 THEN '随机' WHEN 3 THEN '晚餐' END",
    "max_distance": "CASE c_custkey % 3 WHEN 1 THEN 20 WHEN 2 THEN 35 END",
    "category": "CASE c_custkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' WHEN 3 THEN '随便' WHEN 4 THEN 'STANDARD' WHEN 5 THEN 'ABSENT' END",
    "taste": "CASE c_custkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN '想吃blue' WHEN 2 THEN '不吃辣' WHEN 4 THEN 'old' WHEN 5 THEN 'bolt' END",
    "group_size": "CASE c_custkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 END",
}
AVOID = "CASE c_custkey % 8 WHEN 1 THEN {a}'ring'{z} WHEN 2 THEN {a}'Brand#1', 'cold'{z} WHEN 3 THEN {a}'a'{z} ELSE {e} END"
LIKED = "CASE c_custkey % 3 WHEN 0 THEN {a}'Small', 'plate'{z} ELSE {e} END"
EXCLUDED = "CASE WHEN c_custkey % 9 = 0 THEN {a}c_custkey % 2000, c_custkey % 500 + 7, 3{z} ELSE {e} END"
SPARK = dict(a="array(", z=")", e="CAST(array() AS ARRAY<STRING>)")
DUCK = dict(a="[", z="]", e="CAST([] AS VARCHAR[])")
NUM_SPARK, NUM_DUCK = dict(SPARK, e="CAST(array() AS ARRAY<BIGINT>)"), dict(DUCK, e="CAST([] AS BIGINT[])")


def candidates(spark, sf_dir):
    rows = view(spark, sf_dir, "candidates")
    tags = F.split("name", " ")
    return rows.select(
        "*", tags.alias("tastes"), F.array("category").alias("categories"), F.expr(MEALS.format(**SPARK)).alias("meal_times"),
        F.expr(FITS.format(**SPARK)).alias("suitable_for"),
        R.record_text(F.col("name"), F.col("place"), F.col("category"), F.concat_ws(" ", tags),
                      F.when(F.col("id") % 10 == 0, R.SPICE_CHARACTER)).alias("text"),
    )


def requests(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        *[f"{e} AS {n}" for n, e in REQUEST.items()], f"{AVOID.format(**SPARK)} AS avoid", f"{LIKED.format(**SPARK)} AS liked",
        f"{EXCLUDED.format(**NUM_SPARK)} AS excluded",
    )


BASE = f"""WITH {view_sql('candidates')},
    cands AS (SELECT *, string_split(name, ' ') AS tastes, {MEALS.format(**DUCK)} AS meal_times, {FITS.format(**DUCK)} AS suitable_for,
      lower(concat_ws(' ', name, place, category, name, CASE WHEN id % 10 = 0 THEN '辣' END)) AS text FROM candidates),
    reqs AS (SELECT {', '.join(f'{e} AS {n}' for n, e in REQUEST.items())}, {AVOID.format(**DUCK)} AS avoid, {LIKED.format(**DUCK)} AS liked, {EXCLUDED.format(**NUM_DUCK)} AS excluded FROM customer)"""


def free(name, *also):
    return f"({name} IS NULL OR {name} IN ('', '随机', '随便'{''.join(f''', '{a}' ''' for a in also)}))"


def cascade_sql(kind: str) -> str:
    """Direct form: every request against every candidate."""
    first = "(max_distance IS NULL OR distance <= max_distance)" if kind == "restaurant" else f"({free('meal')} OR list_contains(meal_times, meal))"
    party = ("(group_size IS NULL OR len(suitable_for) = 0 OR list_contains(suitable_for, CASE WHEN group_size = 1 THEN '一人食' WHEN group_size = 2 THEN '两人' ELSE '聚餐' END))"
             if kind == "restaurant" else "true")
    limit = "budget" if kind == "canteen" else "coalesce(nullif(budget, 0), remembered_budget, budget)"
    units = f"""greatest(1, weight * 100 + CASE WHEN taste = '不吃辣' THEN CASE WHEN contains(text, '辣') THEN -90 ELSE 100 END WHEN NOT {free('taste')} AND contains(text, replace(taste, '想吃', '')) THEN 200 ELSE 0 END
        + CASE WHEN NOT {free('r.category')} AND contains(text, lower(r.category)) THEN 200 ELSE 0 END + CASE WHEN len(list_filter(liked, lambda w: contains(text, lower(w)))) > 0 THEN 150 ELSE 0 END)"""
    return f"""pairs AS (SELECT r.request_id, c.id, c.price, {units} AS units, true AS s0, {limit} IS NULL OR price <= {limit} AS s1, {first} AS s2,
        {free('r.category')} OR c.category = r.category AS s3, {free('taste', '不吃辣')} OR list_contains(tastes, taste) AS s4, {party} AS s5,
        len(list_filter(avoid, lambda w: contains(text, lower(w)))) = 0 AS s6, coalesce(taste <> '不吃辣', true) OR NOT contains(text, '辣') AS s7
      FROM reqs r JOIN cands c ON c.enabled AND NOT list_contains(r.excluded, c.id)),
    passed AS (SELECT request_id, id, price, units, s0, s1, s1 AND s2 AS t2, s1 AND s2 AND s3 AS t3, s1 AND s2 AND s3 AND s4 AS t4, s1 AND s2 AND s3 AND s4 AND s5 AS t5,
        s1 AND s2 AND s3 AND s4 AND s5 AND s6 AS t6, s1 AND s2 AND s3 AND s4 AND s5 AND s6 AND s7 AS t7 FROM pairs),
    counted AS (SELECT request_id, count(*) AS n_enabled, count(*) FILTER (s1) AS n_budget, count(*) FILTER (t2) AS n_first, count(*) FILTER (t3) AS n_category, count(*) FILTER (t4) AS n_taste,
        count(*) FILTER (t5) AS n_party, count(*) FILTER (t6) AS n_avoid, count(*) FILTER (t7) AS n_no_spice, CAST(coalesce(sum(units) FILTER (t7), 0) AS BIGINT) AS total_units FROM passed GROUP BY request_id)"""


def parts(spark, sf_dir, kind):
    shaped = R.shaped_requests(requests(spark, sf_dir), kind)
    steps = R.cumulative(R.stage_rows(candidates(spark, sf_dir), shaped, kind))
    return shaped, steps, R.stage_counts(shaped, steps)


COUNTS = ["request_id"] + [f"n_{s}" for s in R.STAGES]


@query("g2_candidate_filter", f"{BASE}, {cascade_sql('canteen')} SELECT {', '.join(COUNTS)} FROM counted")
def canteen_filter(spark, sf_dir):
    return parts(spark, sf_dir, "canteen")[2].select(*COUNTS)


@query("g2q_takeaway_filter", f"{BASE}, {cascade_sql('takeaway')} SELECT {', '.join(COUNTS)} FROM counted")
def takeaway_filter(spark, sf_dir):
    return parts(spark, sf_dir, "takeaway")[2].select(*COUNTS)


@query("j9_match_constraints", f"{BASE}, {cascade_sql('restaurant')} SELECT {', '.join(COUNTS)} FROM counted")
def restaurant_filter(spark, sf_dir):
    return parts(spark, sf_dir, "restaurant")[2].select(*COUNTS)


def blocker_sql(kind: str) -> str:
    named = R.STAGES[1:] if kind == "canteen" else R.STAGES[1:6]
    whens = " ".join(f"WHEN n_{b} > 0 AND n_{s} = 0 THEN '{s}'" for b, s in zip(R.STAGES, R.STAGES[1:]) if s in named)
    return f"SELECT request_id, '{kind}' AS kind, CASE WHEN n_no_spice > 0 THEN NULL {whens} ELSE 'default' END AS blocker FROM counted"


@query("g3_first_blocker", f"{BASE}, {cascade_sql('canteen')} {blocker_sql('canteen')}")
def blocker(spark, sf_dir):
    counted = parts(spark, sf_dir, "canteen")[2]
    return counted.select("request_id", F.lit("canteen").alias("kind"), R.first_blocker(counted, "canteen").alias("blocker"))


@query("g3_first_blocker_restaurant", f"{BASE}, {cascade_sql('restaurant')} {blocker_sql('restaurant')}")
def blocker_out(spark, sf_dir):
    counted = parts(spark, sf_dir, "restaurant")[2]
    return counted.select("request_id", F.lit("restaurant").alias("kind"), R.first_blocker(counted, "restaurant").alias("blocker"))


@query("g4_soft_score", f"{BASE}, {cascade_sql('canteen')} SELECT request_id, n_no_spice AS candidates, total_units / 100 AS total_score FROM counted")
def soft_score(spark, sf_dir):
    counted = parts(spark, sf_dir, "canteen")[2]
    return counted.select("request_id", F.col("n_no_spice").alias("candidates"), (F.col("total_units") / R.UNITS).alias("total_score"))


@query("g5_weighted_pick", f"""{BASE}, {cascade_sql('canteen')},
    along AS (SELECT request_id, id, units, sum(units) OVER (PARTITION BY request_id ORDER BY price, id) AS upto, total_units FROM passed JOIN counted USING (request_id) WHERE t7),
    placed AS (SELECT *, CAST(concat('0x', substr(md5(concat('seed-1|', request_id)), 1, 15)) AS HUGEINT) * total_units // 1152921504606846976 AS place FROM along)
    SELECT request_id, id, units, total_units FROM placed WHERE upto > place AND upto - units <= place""")
def pick(spark, sf_dir):
    shaped, steps, counted = parts(spark, sf_dir, "canteen")
    return R.weighted_pick(shaped, steps, counted, "seed-1")


@query("g6_record_text", f"{BASE} SELECT id, text FROM cands")
def texts(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", "text")


DISH = "concat(p_name, ' ', CAST(p_partkey AS STRING))"
VERSIONS = f"""CASE WHEN p_partkey % 2 = 1 THEN
    concat('{{"updated_at": "day 3", "dishes": [{{"food_name": "', {DISH}, '", "venue": "', p_brand, '", "meal_time": "午餐", "taste": "', split_part(p_name, ' ', 1), '", "price": ', CAST(p_size AS STRING), '.5, "stall": 7}}, {{"food_name": " "}}], "restaurants": [{{"name": "', p_brand, '", "tags": ["a", "b"], "distance": "near"}}], "venues": [{{"name": "', {DISH}, '", "evidence": "seen", "locked": true}}]}}')
  ELSE concat('{{"schema_version": 2, "canteen_dishes": [{{"food_name": "', {DISH}, '", "venue": "', p_brand, '", "meal_times": ["早餐"], "weight": ', CAST(p_size % 3 + 1 AS STRING), ', "price": ', CAST(p_size AS STRING), '.5}}]}}') END"""
DISH_SQL = "concat(p_name, ' ', p_partkey)"
OLD_ID = f"concat('canteen_', substr(sha1(concat(lower(p_brand), '||', lower({DISH_SQL}))), 1, 12))"
NEW_ID = f"concat('canteen_', substr(sha1(concat(lower({DISH_SQL}), '|', lower(p_brand), '|')), 1, 12))"


def catalogue_records(spark, sf_dir):
    return migrate_catalogue(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{VERSIONS} AS value"))[0]


@query("s2_migrate_catalogue", f"""SELECT p_partkey, 'canteen_dishes' AS collection, {OLD_ID} AS id, {DISH_SQL} AS label, '午餐' AS meals, split_part(p_name, ' ', 1) AS tastes, NULL AS area, NULL AS status, '7' AS stall FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, 'restaurants', concat('restaurant_', substr(sha1(concat(lower(p_brand), '|')), 1, 12)), p_brand, NULL, 'a|b', 'near', NULL, NULL FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, 'pending_review', concat('pending_', substr(sha1(concat('canteen_venue|', lower({DISH_SQL}), '|')), 1, 12)), {DISH_SQL}, NULL, NULL, NULL, 'pending', NULL FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, 'canteen_dishes', NULL, {DISH_SQL}, '早餐', NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 2 = 0""")
def migrated(spark, sf_dir):
    return catalogue_records(spark, sf_dir).select(
        "p_partkey", "collection", "id", F.coalesce("food_name", "name").alias("label"), F.array_join("meal_times", "|").alias("meals"),
        F.array_join("tastes", "|").alias("tastes"), "area", "status", F.col("rest")["stall"].alias("stall"),
    )


@query("s2_catalogue_to_pick", f"""WITH cands AS (SELECT CASE WHEN p_partkey % 2 = 1 THEN {OLD_ID} ELSE {NEW_ID} END AS id, p_size + 0.5::DOUBLE AS price, CASE WHEN p_partkey % 2 = 1 THEN 100 ELSE (p_size % 3 + 1) * 100 END AS units,
      CASE WHEN p_partkey % 2 = 1 THEN '午餐' ELSE '早餐' END AS meal FROM part),
    reqs AS (SELECT c_custkey AS request_id, c_custkey % 50 AS budget, CASE c_custkey % 3 WHEN 0 THEN '午餐' WHEN 1 THEN '早餐' END AS meal FROM customer),
    along AS (SELECT request_id, id, units, sum(units) OVER (PARTITION BY request_id ORDER BY price, id) AS upto, sum(units) OVER (PARTITION BY request_id) AS total_units
      FROM reqs r JOIN cands c ON c.price <= r.budget AND (r.meal IS NULL OR c.meal = r.meal)),
    placed AS (SELECT *, CAST(concat('0x', substr(md5(concat('chain|', request_id)), 1, 15)) AS HUGEINT) * total_units // 1152921504606846976 AS place FROM along)
    SELECT request_id, id, CAST(units AS BIGINT) AS units, CAST(total_units AS BIGINT) AS total_units FROM placed WHERE upto > place AND upto - units <= place""")
def catalogue_to_pick(spark, sf_dir):
    """Catalogue texts of both versions, read, migrated, normalised, ranked and drawn from."""
    dishes = catalogue_records(spark, sf_dir).filter("collection = 'canteen_dishes'")
    chosen = R.normalise_catalogue(dishes, "canteen", ("price", "category")).withColumns({
        "categories": F.array_compact(F.array("category")), "text": R.record_text(F.col("food_name"), F.col("venue"), F.array_join("tastes", " "))})
    asked = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id", "c_custkey % 50 AS budget", "CAST(NULL AS DOUBLE) AS remembered_budget", "CASE c_custkey % 3 WHEN 0 THEN '午餐' WHEN 1 THEN '早餐' END AS meal",
        "CAST(NULL AS INT) AS max_distance", "CAST(NULL AS STRING) AS category", "CAST(NULL AS STRING) AS taste", "CAST(NULL AS INT) AS group_size",
        f"{SPARK['e']} AS avoid", f"{SPARK['e']} AS liked", f"{SPARK['e']} AS excluded",
    )
    shaped = R.shaped_requests(asked, "canteen")
    steps = R.cumulative(R.stage_rows(materialise(chosen, "dishes"), shaped, "canteen"))
    return R.weighted_pick(shaped, steps, R.stage_counts(shaped, steps), "chain")


ID_SQL = "concat('canteen_', substr(sha1(concat_ws('|', lower(coalesce({0}, '')), lower(p_brand), '')), 1, 12))"


@query("g1_normalise_catalogue", f"""SELECT CASE WHEN p_partkey % 5 = 0 THEN concat('kept_', p_partkey) ELSE {ID_SQL.format('p_name')} END AS id, p_name AS name, p_name AS food_name, p_brand AS venue,
    CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE CAST(p_size AS DOUBLE) END AS weight, CAST(p_partkey % 7 <> 0 AS BIGINT) AS enabled, CASE WHEN p_partkey % 4 = 0 THEN 'legacy' ELSE 'manual' END AS origin,
    CAST(CASE WHEN p_partkey % 6 = 0 THEN true ELSE p_partkey % 4 <> 0 END AS BIGINT) AS locked, '' AS notes, split_part(p_name, ' ', 1) AS tastes, CASE WHEN p_partkey % 2 = 0 THEN '午餐' ELSE '' END AS meal_times FROM part""")
def catalogue(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 5 = 0 THEN concat('kept_', p_partkey) END AS id", "p_name AS name", "p_name AS food_name", "p_brand AS venue", "CAST(NULL AS STRING) AS source_url",
        "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS weight", "CASE WHEN p_partkey % 7 = 0 THEN false END AS enabled",
        "CASE WHEN p_partkey % 4 = 0 THEN 'legacy' END AS origin", "CASE WHEN p_partkey % 6 = 0 THEN true END AS locked", "CAST(NULL AS STRING) AS notes",
        "CASE WHEN p_partkey % 8 = 0 THEN array(split(p_name, ' ')[0]) END AS tastes", "split(p_name, ' ')[0] AS taste", "CAST(NULL AS ARRAY<STRING>) AS meal_times",
        "CASE WHEN p_partkey % 2 = 0 THEN '午餐' END AS meal_time",
    )
    return R.normalise_catalogue(raw, "canteen").withColumn("tastes", F.array_join("tastes", "|")).withColumn("meal_times", F.array_join("meal_times", "|"))


@query("c14_stable_id", f"SELECT p_partkey, {ID_SQL.format('p_name')} AS id, concat('f_', substr(sha256(p_name), 1, 12)) AS file_id FROM part")
def ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", R.stable_id("canteen", F.col("p_name"), F.col("p_brand"), F.lit(None)).alias("id"),
        F.concat(F.lit("f_"), F.substring(F.sha2("p_name", 256), 1, 12)).alias("file_id"),
    )


@query("c15_array_functions", """SELECT p_partkey, CAST(list_contains(string_split(p_name, ' '), 'red') AS BIGINT) AS is_red,
    array_to_string(list_transform(list_filter(list_zip(xs, range(1, 4)), lambda z: list_position(xs, z[1]) = z[2]), lambda z: z[1]), '|') AS seen, array_to_string(xs[1:2], '|') AS head
    FROM (SELECT p_partkey, p_name, [split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS xs FROM part)""")
def arrays(spark, sf_dir):
    tags = F.split("p_name", " ")
    xs = F.array(tags[1], tags[0], tags[1])
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_contains(tags, "red").alias("is_red"), F.array_join(F.array_distinct(xs), "|").alias("seen"), F.array_join(F.slice(xs, 1, 2), "|").alias("head")
    )


@query("u2_merge_exclusions", """SELECT p_partkey, CASE WHEN p_size % 3 = p_size % 5 THEN concat(p_size % 3, '|', p_size % 7 + 10) WHEN p_size % 5 = p_size % 7 + 10 THEN concat(p_size % 3, '|', p_size % 5)
    ELSE concat(p_size % 3, '|', p_size % 7 + 10, '|', p_size % 5) END AS excluded FROM part""")
def exclusions(spark, sf_dir):
    n = F.col("p_size")
    merged = F.array_union(F.array(n % 3, n % 7 + 10), F.array(n % 5))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged.cast("array<string>"), "|").alias("excluded"))


@query("u3_merge_avoid", "SELECT p_partkey, CASE WHEN p_type = split_part(p_name, ' ', 1) THEN p_type ELSE concat(p_type, '|', split_part(p_name, ' ', 1)) END || CASE WHEN p_size % 2 = 0 THEN '' ELSE '|' || p_brand END AS avoid FROM part")
def avoid_words(spark, sf_dir):
    tags = F.split("p_name", " ")
    asked = F.when(F.col("p_size") % 2 == 0, F.array("p_type", tags[0])).otherwise(F.array(tags[0], F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_union(F.array("p_type"), asked), "|").alias("avoid"))


ASK = ("concat(CASE turn % 4 WHEN 0 THEN '附近吃点，人均 ' WHEN 1 THEN '外卖，预算' WHEN 2 THEN '食堂午饭 ' ELSE '换一个，聚餐' END, CAST(conv_id % 300 AS STRING), ' 块', "
       "CASE conv_id % 5 WHEN 0 THEN '，三个人' WHEN 1 THEN '，和同学一起' WHEN 2 THEN '，12 个人，不辣' WHEN 3 THEN '，清淡的面食和粉' ELSE '，想吃辣，我喜欢小吃' END)")


def says(*words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("g7_parse_requests", f"""WITH asks AS (SELECT conv_id, turn, {ASK} AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN {says('换一个', '不想吃这个', '换一家')} THEN 'change' WHEN {says('以后不要', '以后别', '我不吃', '我喜欢', '我通常')} THEN 'save_preference' WHEN {says('新开', '新店', '联网查', '上网查')} THEN 'search' ELSE 'recommend' END AS action,
      CASE WHEN {says('外卖', '配送', '送到宿舍', '不想出门', '不想出去')} THEN 'takeaway' WHEN {says('附近', '周边', '学校旁', '出去吃', '堂食', '聚餐', '出校门')} THEN 'restaurant' WHEN {says('校内', '食堂', '窗口', '在学校吃')} THEN 'canteen' END AS mode,
      CASE WHEN {says('晚餐', '晚饭')} THEN '晚餐' WHEN {says('午餐', '午饭')} THEN '午餐' WHEN {says('早餐', '早饭')} THEN '早餐' END AS meal_time,
      TRY_CAST(regexp_extract(regexp_extract(t, '(?:人均|预算|以内|不超过|左右)[^0-9]{{0,6}}[0-9]{{1,3}}|[0-9]{{1,3}}\\s*块'), '[0-9]{{1,3}}') AS BIGINT) AS budget,
      CASE WHEN regexp_matches(t, '[0-9]+\\s*个人') THEN CAST(regexp_extract(t, '([0-9]+)\\s*个人', 1) AS BIGINT) WHEN contains(t, '三个人') THEN 3 WHEN {says('女朋友', '男朋友', '对象', '朋友', '同学', '一起')} THEN 2 END AS group_size,
      CASE WHEN {says('不辣', '不吃辣', '不要辣')} THEN '不吃辣' WHEN contains(t, '辣') THEN '想吃辣' WHEN contains(t, '清淡') THEN '清淡' END AS taste,
      CASE WHEN contains(t, '轻食') THEN '轻食' WHEN contains(t, '小吃') THEN '小吃' WHEN contains(t, '粉') THEN '粉' WHEN contains(t, '面食') THEN '面食' WHEN contains(t, '米饭') THEN '米饭' END AS category FROM asks""")
def parsed(spark, sf_dir):
    asks = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{ASK} AS text")
    return R.parse_requests(asks).drop("text")


EVIDENCE = ["page_id AS seq", "regexp_extract(html, '<title>(.*?)</title>', 1) AS title", "CASE WHEN page_id % 9 = 4 THEN 'http://same.example/x' ELSE url END AS url",
            "CASE WHEN page_id % 4 = 0 THEN '新餐厅' ELSE 'notice' END AS snippet"]
PENDING_SQL = f"""evidence AS (SELECT {', '.join(EVIDENCE)} FROM pages),
    pending AS (SELECT concat('old_', seq) AS id, lower(title) AS name, concat(' ', url) AS source_url FROM evidence WHERE seq % 5 = 0),
    firsts AS (SELECT * FROM (SELECT seq, {strip_sql('title')} AS name, {strip_sql('url')} AS url, snippet, row_number() OVER (PARTITION BY {strip_sql('url')} ORDER BY seq) AS n FROM evidence) WHERE n = 1 AND name <> '' AND url <> ''),
    fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(url) ORDER BY seq) AS m FROM firsts) WHERE m = 1
      AND (lower(name), lower(url)) NOT IN (SELECT (lower({strip_sql('name')}), lower({strip_sql('source_url')})) FROM pending)),
    additions AS (SELECT concat('pending_', substr(sha1(lower(concat(name, '|', url))), 1, 12)) AS id, CASE WHEN contains(concat(name, snippet), '餐厅') THEN 'restaurant' ELSE 'food_notice' END AS record_type,
      name, url AS source_url, snippet AS source_snippet, 'pending' AS status FROM fresh)"""


def found_evidence(spark, sf_dir):
    evidence = table(spark, sf_dir, "pages").selectExpr(*EVIDENCE)
    pending = evidence.filter("seq % 5 = 0").selectExpr("concat('old_', seq) AS id", "lower(title) AS name", "concat(' ', url) AS source_url")
    return evidence, pending


@query("j4_evidence_to_pending", f"WITH {PENDING_SQL} SELECT * FROM additions")
def new_pending(spark, sf_dir):
    return R.evidence_to_pending(*found_evidence(spark, sf_dir))


@query("g9_discovery_merge", f"WITH {PENDING_SQL} SELECT id, name, source_url, 'kept' AS state FROM pending UNION ALL SELECT id, name, source_url, 'added' FROM additions")
def merged(spark, sf_dir):
    evidence, pending = found_evidence(spark, sf_dir)
    added = R.evidence_to_pending(evidence, pending).select("id", "name", "source_url", F.lit("added").alias("state"))
    return pending.withColumn("state", F.lit("kept")).unionByName(added)


@query("g8_review_transition", f"""WITH {PENDING_SQL}, decided AS (SELECT id, status, CASE WHEN len(name) % 3 = 0 THEN 'approve' WHEN len(name) % 3 = 1 THEN 'ignore' END AS d FROM additions)
    SELECT id, CASE d WHEN 'approve' THEN 'approved' WHEN 'ignore' THEN 'ignored' ELSE status END AS status, CASE WHEN d = 'approve' THEN 'restaurants' END AS collection, CASE WHEN d = 'approve' THEN 'manual' END AS origin FROM decided""")
def reviewed(spark, sf_dir):
    rows = R.evidence_to_pending(*found_evidence(spark, sf_dir))
    chosen = F.when(F.length("name") % 3 == 0, "approve").when(F.length("name") % 3 == 1, "ignore")
    decisions = rows.select("id", chosen.alias("decision"), F.lit("restaurants").alias("collection")).filter("decision IS NOT NULL")
    unknown = rows.select(F.concat(F.lit("unknown_"), "id"), F.lit("approve"), F.lit("takeaways"))
    states, approved = R.review_transition(rows, decisions.union(unknown))
    return states.select("id", "status").join(approved.select("id", "collection", "origin"), "id", "left")


@query("a5_catalogue_status", "SELECT p_type AS collection, count(*) AS records, count(*) FILTER (p_size % 4 = 0) AS pending, max(p_size) AS updated_at FROM part GROUP BY p_type")
def status(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_type AS collection", "CASE WHEN p_size % 4 = 0 THEN 'pending' ELSE 'approved' END AS status", "p_size AS updated_at")
    return R.catalogue_status(rows)
