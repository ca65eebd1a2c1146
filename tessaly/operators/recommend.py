"""Constrained recommendation: filter cascade, named blockers, soft score, weighted draw.

Requests are never paired with candidates. Candidates are numbered in the order of price and id, and
every stage key (an attribute value or a combination that some request asks for) and every distinct
word of the requests has a bitmap of candidate numbers, stored as one row per 64 of them. So a budget is
a prefix of the numbers, the cascade is intersections of words of 64 bits, and running counts and weights
along the blocks of a key turn each stage of a request into one as-of lookup. A weighted draw is a
second lookup, of a random place on the cumulative weight.

Word conditions (avoid, no spice, liked) are bitmaps of words, found once per distinct word, and are
intersected once per distinct request profile and block. Excluded ids of a request are subtracted from
what the lookups gave.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.text import strip
from tessaly.operators.segmented import cut_points, latest_at, ranked, running_sums
from tessaly.sources.folders import materialise

ANYTHING = ("随机", "随便")
NO_SPICE, SPICE_CHARACTER = "不吃辣", "辣"
UNITS = 100  # weights are counted in hundredths, so sums are exact
WEIGHT_BAND = 100_000
BLOCK, SEGMENT, SEED = 64, 1024, 3  # candidates of a block, blocks of a segment, characters by which words meet texts
SENT_WORDS, SENT_BYTES = 100_000, 16 * 2**20  # words that are sent to the texts at most, beyond that both are shuffled
ALL_CANDIDATES = 2**40
RAISES = (("taste_bits", 200), ("category_bits", 200), ("liked_bits", 150))
NO_SPICE_UNITS = 100
NO_LIMIT = 10**12
PARTY_LABELS = ("一人食", "两人", "聚餐")
STAGES = ("enabled", "budget", "first", "category", "taste", "party", "avoid", "no_spice")


def record_text(*values: Column) -> Column:
    """Lower-cased concatenation of names and labels, the text word conditions look at."""
    return F.lower(F.concat_ws(" ", *values))


def stable_id(prefix: str, *parts: Column) -> Column:
    raw = F.concat_ws("|", *[F.lower(strip(F.coalesce(p.cast("string"), F.lit("")))) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(raw), 1, 12))


def normalise_catalogue(raw: DataFrame, prefix: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Stable ids and defaults of catalogue records; the columns ``also`` stay as they are.

    Records may lack the single values ``taste`` and ``meal_time``, as those of the current version do.
    """
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("taste", "meal_time") if c not in raw.columns})
    origin = F.coalesce("origin", F.lit("manual"))
    return raw.select(
        F.coalesce("id", stable_id(prefix, F.coalesce("food_name", "name"), F.col("venue"), F.col("source_url"))).alias("id"),
        "name", "food_name", "venue", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("enabled", F.lit(True)).alias("enabled"),
        origin.alias("origin"), F.coalesce("locked", origin == "manual").alias("locked"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.when(F.size(F.coalesce("tastes", F.array())) > 0, F.col("tastes"))
        .otherwise(F.coalesce(F.array_compact(F.array("taste")), F.array())).alias("tastes"),
        F.when(F.size(F.coalesce("meal_times", F.array())) > 0, F.col("meal_times"))
        .otherwise(F.coalesce(F.array_compact(F.array("meal_time")), F.array())).alias("meal_times"), *also,
    )


def _free(value: Column, *also: str) -> Column:
    return value.isNull() | value.isin("", *ANYTHING, *also)


def party_label(size: Column) -> Column:
    return F.when(size == 1, PARTY_LABELS[0]).when(size == 2, PARTY_LABELS[1]).when(size > 2, PARTY_LABELS[2])


def shaped_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Stage keys, profile and budget limit of each request.

    ``requests``: request_id, budget, remembered_budget, meal, max_distance, category, taste,
    group_size, avoid, liked, excluded. The canteen ignores the remembered budget.
    """
    star = lambda name, *also: F.when(_free(F.col(name), *also), "*").otherwise(F.col(name))
    first = F.coalesce(F.col("max_distance").cast("string"), F.lit("*")) if kind == "restaurant" else star("meal")
    party = F.coalesce(party_label(F.col("group_size")), F.lit("*")) if kind == "restaurant" else F.lit("*")
    budget = F.col("budget") if kind == "canteen" else F.coalesce(F.nullif(F.col("budget"), F.lit(0)), F.col("remembered_budget"), F.col("budget"))
    keyed = (
        requests.withColumn("_f", first).withColumn("_c", star("category")).withColumn("_t", star("taste", NO_SPICE)).withColumn("_p", party)
        .withColumn("limit", F.coalesce(budget.cast("double"), F.lit(float(NO_LIMIT))))
        .withColumn("no_spice", F.coalesce(F.col("taste") == NO_SPICE, F.lit(False)))
        .withColumn("key5", F.concat_ws("|", F.lit("5"), "_f", "_c", "_t", "_p"))
    )
    profile = F.concat_ws("\x1f", "key5", F.col("no_spice").cast("string"), F.array_join("avoid", "\x1e"), F.array_join("liked", "\x1e"))
    return keyed.withColumn("profile", profile).withColumn(
        "keys",
        F.array(
            F.lit("1"), F.lit("1"), F.concat_ws("|", F.lit("2"), "_f"), F.concat_ws("|", F.lit("3"), "_f", "_c"),
            F.concat_ws("|", F.lit("4"), "_f", "_c", "_t"), F.col("key5"), F.concat(F.lit("6"), "profile"), F.concat(F.lit("7"), "profile"),
        ),
    )


def _indexed(candidates: DataFrame, kind: str, tiers: Column) -> DataFrame:
    """Enabled candidates with the key lists of their attributes; ``*`` matches any request."""
    listed = lambda column: F.array_distinct(F.concat(column, F.array(F.lit("*"))))
    enabled = candidates.filter(F.coalesce("enabled", F.lit(True))).withColumn(
        "price", F.coalesce(F.col("price").cast("double"), F.lit(float(NO_LIMIT - 1)))  # an unknown price fits no budget, but needs none
    )
    if kind == "restaurant":
        # Distances are whole minutes, so the distinct limits (a scalar array) are few.
        reach = F.transform(F.filter(F.col("_tiers"), lambda t: F.col("distance") <= t), lambda t: t.cast("string"))
        enabled = enabled.withColumn("_tiers", tiers).withColumn("_f", listed(F.coalesce(reach, F.array().cast("array<string>"))))
        fits = F.when(F.size("suitable_for") > 0, F.col("suitable_for")).otherwise(F.array(*[F.lit(x) for x in PARTY_LABELS]))
        enabled = enabled.withColumn("_p", listed(fits))
    else:
        enabled = enabled.withColumn("_f", listed(F.col("meal_times"))).withColumn("_p", F.array(F.lit("*")))
    return enabled.withColumn("_c", listed(F.col("categories"))).withColumn("_t", listed(F.col("tastes")))


class Bitmaps(NamedTuple):
    """Candidates in the order of price and id, and what is known of each run of 64 of them.

    ``ordered``: ordinal, block, bit, id, price, base. ``blocks``: block, spice bits, ``weights``
    (distinct base weight, bits). ``prices``: price, upto, segment. ``cuts``: prices that part segments.
    ``rows``: key, block, bits, units and, for the last stage, the bits that raise a weight.
    """

    ordered: DataFrame
    blocks: DataFrame
    prices: DataFrame
    cuts: Column
    rows: DataFrame


def _low(places: Column) -> Column:
    """A word with that many low bits set, 0 to 63."""
    return F.when(places == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(BLOCK) - places).cast("int")))


def _and(*words: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), words)


def order_candidates(indexed: DataFrame) -> tuple[DataFrame, Column]:
    """Every candidate's place in the order of price and id, counted over segments taken from the data."""
    cuts = cut_points(indexed, ["price", "id"])
    segmented = indexed.withColumn("_segment", F.size(F.filter(cuts, lambda c: c <= F.struct("price", "id"))))
    ordinal = F.col("_rank").cast("bigint") - 1
    placed = ranked(segmented, [], "_segment", [F.col("price"), F.col("id")], "_rank").select(
        "*", ordinal.alias("ordinal"), F.floor(ordinal / BLOCK).alias("block"), F.pmod(ordinal, F.lit(BLOCK)).cast("int").alias("place"))
    return placed.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))), cuts


def word_bitmaps(ordered: DataFrame, words: DataFrame) -> DataFrame:
    """(word, block, bits) of the texts that contain each distinct word.

    Words meet texts by their first characters, at most ``SEED``; only such pairs are compared in full. A counted number of words
    goes to the texts; beyond it texts and words are shuffled. The beginnings of all texts are never sent anywhere whole.
    """
    text, length = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    cut = lambda n: F.transform(F.sequence(F.lit(1), length), lambda i: text.substr(i, F.lit(n)))
    seeds = F.array_distinct(F.concat(*[cut(n) for n in range(1, SEED + 1)], F.array(F.lit(""))))
    seeded = materialise(words.select("word", F.substring("word", 1, SEED).alias("seed")), "words")
    size = seeded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= SENT_WORDS and size["bytes"] <= SENT_BYTES
    met = ordered.select("block", "bit", "text", F.explode(seeds).alias("seed")).join(seeded.hint("broadcast" if few else "merge"), "seed")
    return met.filter(text.contains(F.col("word"))).groupBy("word", "block").agg(F.bit_or("bit").alias("bits"))


def profile_words(profiles: DataFrame) -> DataFrame:
    """(profile, role, word): what each profile avoids, likes and asks for. Null words say nothing."""
    none = F.array().cast("array<string>")
    listed = lambda name: F.transform(F.coalesce(F.col(name), none), lambda w: F.struct(F.lit(name).alias("role"), F.lower(w).alias("word")))
    taste = F.when(~F.col("no_spice") & ~_free(F.col("taste")), F.replace(F.col("taste"), F.lit("想吃"), F.lit("")))
    category = F.when(~_free(F.col("category")), F.lower("category"))
    single = F.array(F.struct(F.lit("taste").alias("role"), taste.alias("word")), F.struct(F.lit("category").alias("role"), category.alias("word")))
    return profiles.select("profile", F.explode(F.concat(listed("avoid"), listed("liked"), single)).alias("_a")).select(
        "profile", "_a.*").filter("word IS NOT NULL").distinct()


def units_of(bits: Column) -> Column:
    """Summed score in hundredths of the candidates in ``bits``: base weight and what taste, category and
    liked words add, at least one hundredth each. Reads the columns of a last stage's row and ``weights``."""
    total = F.lit(0).cast("bigint")
    parts = []
    for chosen in product((True, False), repeat=len(RAISES)):
        extra = sum(units for (_, units), on in zip(RAISES, chosen) if on)
        masks = [F.col(name) if on else F.bitwise_not(F.col(name)) for (name, _), on in zip(RAISES, chosen)]
        parts.append((_and(bits, *masks), F.lit(extra) + F.when(F.col("no_spice"), NO_SPICE_UNITS).otherwise(0)))

    def weighed(sum_: Column, w: Column) -> Column:
        for part, extra in parts:
            sum_ = sum_ + F.greatest(F.lit(1).cast("bigint"), w["base"] + extra) * F.bit_count(_and(part, w["bits"]))
        return sum_

    return F.aggregate("weights", total, weighed)


def stage_rows(candidates: DataFrame, shaped: DataFrame, kind: str) -> Bitmaps:
    """Bitmaps of the candidates under every stage key some request asks for; one row holds up to 64 of them."""
    tiers = shaped.agg(F.collect_set("max_distance")).scalar()
    base = F.round(F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0)) * UNITS).cast("bigint")
    indexed = _indexed(candidates, kind, tiers).select(
        "id", "price", F.coalesce("text", F.lit("")).alias("text"), base.alias("base"), "_f", "_c", "_t", "_p")
    placed, cuts = order_candidates(indexed)
    ordered = materialise(placed.drop("_segment", "_rank"), "candidates")
    prices = ordered.groupBy("price").agg((F.max("ordinal") + 1).alias("upto")).withColumn("segment", _price_segment(cuts))

    level2 = F.transform("_f", lambda f: F.concat(F.lit("2|"), f))
    level3 = F.flatten(F.transform("_f", lambda f: F.transform("_c", lambda c: F.concat_ws("|", F.lit("3"), f, c))))
    level4 = F.flatten(F.transform("_f", lambda f: F.flatten(F.transform("_c", lambda c: F.transform("_t", lambda t: F.concat_ws("|", F.lit("4"), f, c, t))))))
    level5 = F.flatten(F.transform("_f", lambda f: F.flatten(F.transform("_c", lambda c: F.flatten(F.transform(
        "_t", lambda t: F.transform("_p", lambda p: F.concat_ws("|", F.lit("5"), f, c, t, p))))))))
    wanted = shaped.select(F.explode("keys").alias("key")).distinct()
    plain = (
        ordered.select(F.explode(F.concat(F.array(F.lit("1")), level2, level3, level4, level5)).alias("key"), "block", "bit")
        .join(wanted, "key", "left_semi").groupBy("key", "block").agg(F.bit_or("bit").alias("bits"))
    )
    blocks = (
        ordered.groupBy("block", "base").agg(
            F.bit_or("bit").alias("bits"), F.bit_or(F.when(F.col("text").contains(SPICE_CHARACTER), F.col("bit")).otherwise(0)).alias("spice"))
        .groupBy("block").agg(F.bit_or("spice").alias("spice"), F.collect_list(F.struct("base", "bits")).alias("weights"))
    )
    stored = materialise(plain, "stages")

    profiles = shaped.groupBy("profile").agg(*[F.any_value(c).alias(c) for c in ("key5", "no_spice", "avoid", "liked", "taste", "category")])
    asked = profile_words(profiles)
    by_role = {f"{role}_bits": F.bit_or(F.when(F.col("role") == role, F.col("bits")).otherwise(0)) for role in ("avoid", "liked", "taste", "category")}
    marks = asked.join(word_bitmaps(ordered, asked.select("word").distinct()), "word").groupBy("profile", "block").agg(
        *[bits.alias(name) for name, bits in by_role.items()])
    reached = (
        profiles.select("profile", "key5", "no_spice").join(stored.withColumnRenamed("key", "key5"), "key5")
        .join(marks, ["profile", "block"], "left").fillna(0, list(by_role)).join(blocks, "block")
        .withColumn("_six", _and(F.col("bits"), F.bitwise_not(F.col("avoid_bits"))))
        .withColumn("_seven", F.when(F.col("no_spice"), _and(F.col("_six"), F.bitwise_not(F.col("spice")))).otherwise(F.col("_six")))
    )
    zero = F.lit(0).cast("bigint")
    raised = [name for name, _ in RAISES]
    both = F.array(
        F.struct(F.concat(F.lit("6"), "profile").alias("key"), F.col("_six").alias("bits"), zero.alias("units")),
        F.struct(F.concat(F.lit("7"), "profile").alias("key"), F.col("_seven").alias("bits"), units_of(F.col("_seven")).alias("units")),
    )
    last = reached.select("block", *raised, F.explode(both).alias("_b")).select("_b.key", "block", "_b.bits", "_b.units", *raised).filter("bits <> 0")
    rows = stored.select("key", "block", "bits", zero.alias("units"), *[zero.alias(name) for name in raised]).unionByName(last)
    return Bitmaps(ordered, blocks, prices, cuts, rows)


def _price_segment(cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c["price"] <= F.col("price")))


def cumulative(bitmaps: Bitmaps) -> Bitmaps:
    """Counts and weights up to and including each block, along the price of its key. Written once, read by every lookup."""
    banded = bitmaps.rows.withColumn("band", F.floor(F.col("block") / SEGMENT))
    totals = {"count_to": F.bit_count("bits"), "units_to": F.col("units")}
    summed = running_sums(banded, ["key"], "band", [F.col("block")], totals)
    return bitmaps._replace(rows=materialise(summed, "cascade"))


def stage_counts(shaped: DataFrame, steps: Bitmaps) -> DataFrame:
    """Survivors of every stage and the total weight per request, exclusions subtracted.

    A budget is a number of candidates in price order: whole blocks before it come from the running
    counts, of the block it lies in the low bits are counted. Also the excluded intervals on the
    cumulative weight, in order (a request excludes what it was shown before, so the list is part of its row).
    """
    limits = shaped.select(F.col("limit").alias("price")).distinct().withColumn("segment", _price_segment(steps.cuts))
    places = latest_at(limits, steps.prices, [], "segment", "price", ["upto"]).select(F.col("price").alias("limit"), F.coalesce("upto", F.lit(0)).alias("upto"))
    placed = materialise(places, "limits")  # of a known size, so that limits go to the requests and not requests to the limits
    stages = shaped.join(placed, "limit").select(
        "request_id", "excluded", "no_spice", F.posexplode("keys").alias("stage", "key"), "upto"
    ).withColumn("upto", F.when(F.col("stage") == 0, ALL_CANDIDATES).otherwise(F.col("upto")))
    block = F.floor(F.col("upto") / BLOCK)
    probes = stages.select(
        "request_id", "stage", "key", "no_spice", block.alias("block"), _low(F.pmod("upto", F.lit(BLOCK))).alias("below"), F.floor(block / SEGMENT).alias("band"))
    raised = [name for name, _ in RAISES]
    values = ["last_block", "bits", "units", "count_to", "units_to", *raised]
    marks = steps.rows.select("key", "band", "block", F.col("block").alias("last_block"), *values[1:])
    got = latest_at(probes, marks, ["key"], "band", "block", values).withColumn(
        "_kept", F.when(F.col("last_block") == F.col("block"), _and(F.col("bits"), F.col("below"))).otherwise(F.col("bits")))
    final = F.col("stage") == len(STAGES) - 1
    weights = steps.blocks.select("block", "weights")
    # Only the last stage of a request weighs, and only one block of it.
    weighed = got.join(weights.withColumnRenamed("block", "last_block"), "last_block", "left")
    found = weighed.select(
        "request_id", "stage", F.coalesce(F.col("count_to") - F.bit_count("bits") + F.bit_count("_kept"), F.lit(0)).alias("n"),
        F.when(final, F.coalesce(F.col("units_to") - F.col("units") + units_of(F.col("_kept")), F.lit(0))).otherwise(0).alias("units"))

    left_out = shaped.select("request_id", F.explode(F.array_distinct("excluded")).alias("id")).join(steps.ordered.select("id", "ordinal", "block", "place", "bit"), "id")
    removed = (
        left_out.join(stages.drop("excluded"), "request_id").filter(F.col("ordinal") < F.col("upto"))
        .join(steps.rows.drop("band").hint("merge"), ["key", "block"]).filter(_and(F.col("bits"), F.col("bit")) != 0).join(weights, "block")
        .withColumn("own", F.when(final, units_of(F.col("bit"))).otherwise(0))
        .withColumn("start", F.when(final, F.col("units_to") - F.col("units") + units_of(_and(F.col("bits"), _low(F.col("place"))))).otherwise(0))
    )
    per_stage = removed.groupBy("request_id", "stage").agg(
        F.count(F.lit(1)).alias("gone"), F.sum("own").alias("gone_units"),
        F.array_sort(F.collect_list(F.struct("start", F.col("own").alias("units")))).alias("intervals"),
    )
    net = found.join(per_stage, ["request_id", "stage"], "left")
    counts = [
        F.max(F.when(F.col("stage") == i, F.col("n") - F.coalesce("gone", F.lit(0)))).alias(f"n_{name}") for i, name in enumerate(STAGES)
    ]
    return net.groupBy("request_id").agg(
        *counts, F.max(F.when(final, F.col("units") - F.coalesce("gone_units", F.lit(0)))).alias("total_units"),
        F.max(F.when(final, F.col("intervals"))).alias("intervals"),
    )


def first_blocker(counted: DataFrame, kind: str) -> Column:
    """Name of the first stage which emptied a non-empty set; null when something is left.

    Avoid and no-spice name themselves only for the canteen.
    """
    named = STAGES[1:6] + (STAGES[6:] if kind == "canteen" else ())
    blocker = F.lit(None).cast("string")
    for before, stage in reversed(list(zip(STAGES, STAGES[1:]))):
        if stage in named:
            blocker = F.when((F.col(f"n_{before}") > 0) & (F.col(f"n_{stage}") == 0), stage).otherwise(blocker)
    return F.when(F.col(f"n_{STAGES[-1]}") == 0, F.coalesce(blocker, F.lit("default")))


def drawn_steps(shaped: DataFrame, steps: DataFrame, counted: DataFrame, seed: str, values: list[str]) -> DataFrame:
    """One draw per request: the step of its last stage which holds a random place on the cumulative weight.

    A 60-bit number from a hash of seed and request is scaled to the remaining weight; the
    place then jumps over excluded intervals. ``at`` is the place, ``start`` where the step begins.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("request_id").cast("string"))), 1, 15), 16, 10)
    place = F.expr("(CAST(_number AS DECIMAL(19,0)) * CAST(total_units AS DECIMAL(18,0))) div 1152921504606846976")
    drawn = (
        counted.filter("total_units > 0").join(shaped.select("request_id", F.col("keys")[7].alias("key")), "request_id")
        .withColumn("_number", number).withColumn("_place", place)
        .withColumn(
            "at",
            F.aggregate(
                F.coalesce("intervals", F.array().cast("array<struct<start:bigint,units:bigint>>")), F.col("_place"),
                lambda t, e: F.when(e["start"] <= t, t + e["units"]).otherwise(t),
            ),
        )
        .select("request_id", "key", "total_units", "at", F.floor(F.col("at") / WEIGHT_BAND).alias("band"))
    )
    starts = steps.filter(F.col("key").startswith("7")).withColumn("at", F.col("units_to") - F.col("units")).select(
        "key", "at", F.col("at").alias("start"), F.floor(F.col("at") / WEIGHT_BAND).alias("band"), *values)
    return latest_at(drawn, starts, ["key"], "band", "at", ["start", *values])


def weighted_pick(shaped: DataFrame, steps: Bitmaps | DataFrame, counted: DataFrame, seed: str) -> DataFrame:
    """One candidate per request, probability proportional to the soft score, repeatable by seed.

    ``steps`` are bitmaps, or rows of single candidates: key, id, units, units_to.
    """
    if isinstance(steps, DataFrame):
        return drawn_steps(shaped, steps, counted, seed, ["id", "units"]).select("request_id", "id", "units", "total_units")
    hit = drawn_steps(shaped, steps.rows, counted, seed, ["block", "bits", *[name for name, _ in RAISES]])
    # Of one block per request, the candidates are weighed one by one.
    members = (
        hit.join(shaped.select("request_id", "no_spice"), "request_id")
        .join(steps.ordered.select("block", "place", "bit", "base", "id"), "block").filter(_and(F.col("bits"), F.col("bit")) != 0)
        .withColumn("weights", F.array(F.struct("base", F.col("bit").alias("bits")))).withColumn("own", units_of(F.col("bit")))
    )
    along = Window.partitionBy("request_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        members.withColumn("_to", F.col("start") + F.sum("own").over(along))
        .filter((F.col("_to") > F.col("at")) & (F.col("_to") - F.col("own") <= F.col("at")))
        .select("request_id", "id", F.col("own").alias("units"), "total_units")
    )


def parse_requests(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rules to columns: action, mode, meal, budget, party size, taste, category."""
    t = F.col(text)

    def says(*words: str) -> Column:
        flag = F.lit(False)
        for word in words:
            flag = flag | t.contains(word)
        return flag

    action = (
        F.when(says("换一个", "不想吃这个", "换一家"), "change")
        .when(says("以后不要", "以后别", "我不吃", "我喜欢", "我通常"), "save_preference")
        .when(says("新开", "新店", "联网查", "上网查"), "search").otherwise("recommend")
    )
    mode = (
        F.when(says("外卖", "配送", "送到宿舍", "不想出门", "不想出去"), "takeaway")
        .when(says("附近", "周边", "学校旁", "出去吃", "堂食", "聚餐", "出校门"), "restaurant")
        .when(says("校内", "食堂", "窗口", "在学校吃"), "canteen")
    )
    meal = F.when(says("晚餐", "晚饭"), "晚餐").when(says("午餐", "午饭"), "午餐").when(says("早餐", "早饭"), "早餐")
    pattern = r"(?:人均|预算|以内|不超过|左右)[^\d]{0,6}(\d{1,3})|(\d{1,3})\s*块"
    stated, loose = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    budget = F.coalesce(F.nullif(stated, F.lit("")), F.nullif(loose, F.lit(""))).cast("int")
    people = r"(\d+)\s*个人|([一二三四五六七八九十两]+)个人"
    digits, numeral = F.regexp_extract(t, people, 1), F.regexp_extract(t, people, 2)
    by_numeral = F.lit(2)
    for word, size in (("一", 1), ("三", 3), ("四", 4), ("五", 5), ("六", 6)):
        by_numeral = F.when(numeral == word, size).otherwise(by_numeral)
    group = (
        F.when(digits != "", digits.cast("int")).when(numeral != "", by_numeral)
        .when(says("女朋友", "男朋友", "对象", "朋友", "同学", "一起"), 2)
    )
    taste = F.when(says("不辣", "不吃辣", "不要辣"), "不吃辣").when(says("辣"), "想吃辣").when(says("清淡"), "清淡")
    category = F.lit(None).cast("string")
    for word in ("米饭", "面食", "粉", "小吃", "轻食"):
        category = F.when(says(word), word).otherwise(category)
    named = {"action": action, "mode": mode, "meal_time": meal, "budget": budget, "group_size": group, "taste": taste, "category": category}
    return texts.select("*", *[column.alias(name) for name, column in named.items()])


def evidence_to_pending(evidence: DataFrame, pending: DataFrame) -> DataFrame:
    """New review rows from found pages: URL seen once, (name, url) unknown, blanks dropped.

    First-of-key choices are minimum aggregates on ``seq``.
    """
    tidy = evidence.withColumn("url", strip("url")).filter("url <> ''")
    first = tidy.groupBy("url").agg(F.min_by(F.struct("seq", "title", "snippet"), "seq").alias("e")).select("url", "e.*")
    named = first.withColumn("name", strip("title")).filter("name <> ''").withColumn("_n", F.lower("name")).withColumn("_u", F.lower("url"))
    known = pending.select(F.lower(strip("name")).alias("_n"), F.lower(strip("source_url")).alias("_u")).distinct()
    fresh = named.groupBy("_n", "_u").agg(F.min_by(F.struct("name", "url", "snippet"), "seq").alias("r")).join(known, ["_n", "_u"], "left_anti")
    kind = F.when(F.concat("r.name", "r.snippet").contains("餐厅"), "restaurant").otherwise("food_notice")
    digest = F.substring(F.sha1(F.concat_ws("|", "_n", "_u")), 1, 12)
    return fresh.select(
        F.concat(F.lit("pending_"), digest).alias("id"), kind.alias("record_type"), F.col("r.name").alias("name"),
        F.col("r.url").alias("source_url"), F.col("r.snippet").alias("source_snippet"), F.lit("pending").alias("status"),
    )


def review_transition(pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending rows with new states, approved rows). Decisions on unknown ids have no effect."""
    decided = pending.join(decisions, "id", "left")
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "ignore", "ignored").otherwise(F.col("status"))
    approved = decided.filter("decision = 'approve'").select(
        "id", "collection", F.lit("manual").alias("origin"), F.lit(True).alias("locked"), F.lit(True).alias("enabled")
    )
    return decided.withColumn("status", status).select(*pending.columns), approved


def catalogue_status(records: DataFrame) -> DataFrame:
    return records.groupBy("collection").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "pending").alias("pending"), F.max("updated_at").alias("updated_at")
    )
