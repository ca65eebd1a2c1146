"""Paged documents: boilerplate, page roles, chapter plans, parts.

Input tables are long: one row per page. Page texts are never gathered per document;
what is gathered are keys, page numbers and lengths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaly.functions import vocabulary as V
from tessaly.functions.text import bare_key, contains_any, let, lines, ordered_join, single_spaced, strip
from tessaly.operators.segmented import key_totals, latest_at, neighbour, ranked
from tessaly.sources.folders import materialise


def page_block(page_no: Column | str = "page_no") -> Column:
    """Pages by the thousand: the segment that spreads a long document over tasks."""
    return F.floor((F.col(page_no) if isinstance(page_no, str) else page_no) / 1000)


def with_page_count(pages: DataFrame) -> DataFrame:
    blocked = pages.withColumn("_block", F.coalesce(page_block(), F.lit(0).cast("bigint")))
    return key_totals(blocked, ["doc"], "_block", {"page_count": F.lit(1).cast("bigint")}).drop("_block")


def strip_page_boilerplate(pages: DataFrame) -> DataFrame:
    """Keep only the first occurrence of lines recurring on most pages of a document.

    A recurring key is on at least 60 % of the pages, so a document has fewer than two
    such keys per line of its longest page: the list sent to each page is small.
    """
    each = pages.select("doc", "page_no", F.posexplode(F.transform(lines("text"), strip)).alias("line_no", "line"))
    keyed = each.filter(F.col("line") != "").withColumn("key", bare_key("line"))
    sizes = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    recurring = (
        keyed.filter(F.length("line").between(3, 100) & (F.col("key") != ""))
        .groupBy("doc", "key")
        .agg(F.count_distinct("page_no").alias("on_pages"))
        .join(sizes.filter("n >= 3"), "doc")
        .filter(F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.6)))
        .select("doc", "key")
    )
    first = keyed.join(recurring, ["doc", "key"]).groupBy("doc", "key").agg(
        F.min(F.struct("page_no", "line_no")).alias("first")
    )
    per_doc = first.groupBy("doc").agg(F.collect_list(F.struct("key", "first")).alias("recurring"))

    def kept(line: Column, at: Column) -> Column:
        repeated = F.exists(
            F.col("recurring"),
            lambda r: (r["key"] == bare_key(line))
            & ~((r["first"]["page_no"] == F.col("page_no")) & (r["first"]["line_no"] == at)),
        )
        return (line != "") & ~repeated

    cleaned = F.array_join(F.filter(F.transform(lines("text"), strip), kept), "\n")
    return pages.join(per_doc, "doc", "left").select(
        "doc", "page_no", F.when(F.col("recurring").isNull(), F.col("text")).otherwise(cleaned).alias("text")
    )


def page_role(
    text: Column, page_no: Column, page_count: Column, front_pages: int | None = None, title_pages: int | None = None,
    metadata_chars: int = 2100, title_chars: int = 550,
) -> Column:
    """content, outline or skip. Phrases lose their blanks before the test.

    ``front_pages``: only so many first pages may be outlines or front matter (None: any page). ``title_pages``: so many first pages are
    skipped if they have at most ``title_chars`` characters and teach nothing (None: no page is skipped for being short).
    A page that names its publisher and the like is front matter up to ``metadata_chars`` characters, or with a sure mark of it.
    """
    squeezed = lambda words: [w.replace(" ", "") for w in words]
    early = F.lit(True) if front_pages is None else page_no <= F.least(page_count, F.lit(front_pages))
    title = F.lit(False) if title_pages is None else page_no <= title_pages

    def judge(spaced: Column, key: Column) -> Column:
        metadata = (F.length(key) <= metadata_chars) | contains_any(spaced, V.METADATA_MARKERS)
        return (
            F.when(contains_any(key, squeezed(V.CLOSING_TERMS)), "skip")
            .when(~early, "content")
            .when(contains_any(key, squeezed(V.OUTLINE_TERMS)), "outline")
            .when(contains_any(key, squeezed(V.FRONT_MATTER_TERMS)) & metadata, "skip")
            .when(title & (F.length(key) <= title_chars) & ~spaced.rlike(V.TEACHING_SIGNAL), "skip")
            .otherwise("content")
        )

    return let(
        strip(single_spaced(text)), lambda spaced: let(bare_key(F.lower(spaced)), lambda key: judge(spaced, key))
    )


def with_roles(pages: DataFrame, **limits: int | None) -> DataFrame:
    """Adds page_count and role; ``limits`` are those of ``page_role``."""
    return with_page_count(pages).withColumn("role", page_role(F.col("text"), F.col("page_no"), F.col("page_count"), **limits))


def document_profile(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Kind and processing strategy. Markers are looked for on all pages of a document; no marker spans
    pages, so flags of pages are combined on the map side and no text is gathered."""
    flags = [F.max(F.lower("text").contains(marker)).cast("int") for marker in V.PAPER_MARKERS]
    totals = pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("page_count"),
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("character_count"),
        sum(flags, F.lit(0)).alias("markers"),
    )
    paper = (F.col("markers") >= 2) | F.lower("doc_type").isin("paper", "论文")
    compact = ~F.col("paper") & (F.col("page_count") <= 10) & (F.col("character_count") <= 18000)
    return (
        totals.join(types, "doc").withColumn("paper", paper)
        .select(
            "doc", "page_count", "character_count",
            F.when(F.col("paper"), "paper").when(F.lower("doc_type").isin("course", "课程"), "course").otherwise("other").alias("kind"),
            F.when(compact, "compact_complete").otherwise("chapter_reconstruction").alias("strategy"),
        )
    )


def chapter_starts(roled: DataFrame) -> DataFrame:
    """First chapter line of each content page."""
    candidates = F.filter(
        F.transform(lines("text"), lambda line: strip(single_spaced(line))),
        lambda line: line.rlike(V.CHAPTER_LINE),
    )
    return (
        roled.filter("role = 'content'")
        .withColumn("heading", F.get(candidates, F.lit(0)))
        .filter(F.col("heading").isNotNull())
        .select("doc", "page_no", "heading")
    )


def dedupe_chapter_starts(starts: DataFrame) -> DataFrame:
    """Drop running headers, repeated chapter numbers and answer keys.

    With at most one start per page (what ``chapter_starts`` gives), a start is accepted when
    it is the first of its heading key and, if numbered, the first of its number. Both
    firsts are plain minimum aggregates, so no document is folded in one task.
    """
    cleaned = F.regexp_replace(single_spaced("heading"), r"^[ \-_:：]+|[ \-_:：]+$", "")
    usable = (
        starts.withColumn("heading", cleaned)
        .withColumn("key", bare_key("heading"))
        .withColumn("number", F.regexp_extract("heading", V.CHAPTER_NUMBER, 1))
        .filter((F.col("key") != "") & ~contains_any(F.lower("heading"), V.ANSWER_KEY_MARKERS))
    )
    by_key = usable.groupBy("doc", "key").agg(F.min("page_no").alias("first_of_key"))
    by_number = usable.filter("number <> ''").groupBy("doc", "number").agg(F.min("page_no").alias("first_of_number"))
    return (
        usable.join(by_key, ["doc", "key"])
        .join(by_number, ["doc", "number"], "left")
        .filter((F.col("page_no") == F.col("first_of_key")) & (F.col("page_no") == F.coalesce("first_of_number", "page_no")))
        .select("doc", "page_no", "heading")
    )


def chapter_ranges(starts: DataFrame, page_counts: DataFrame) -> DataFrame:
    """End page = next start - 1, the last chapter ends with the document."""
    placed = starts.withColumn("block", F.floor(F.col("page_no") / 1000))
    return (
        neighbour(placed, ["doc"], "block", ["page_no"], "page_no", "next_start", 1)
        .join(page_counts, "doc")
        .select(
            "doc", "heading", F.col("page_no").alias("start_page"),
            F.greatest("page_no", F.coalesce(F.col("next_start") - 1, F.col("page_count"))).alias("end_page"),
        )
    )


def unique_titles(chapters: DataFrame) -> DataFrame:
    """Second and later chapters of the same title (start pages differ) are marked as continued."""
    first = chapters.groupBy("doc", "title").agg(F.min("start_page").alias("_first"))
    return chapters.join(first, ["doc", "title"]).withColumn(
        "title", F.when(F.col("start_page") > F.col("_first"), F.concat("title", F.lit("（续）"))).otherwise(F.col("title"))
    ).drop("_first")


def fallback_chapters(page_counts: DataFrame) -> DataFrame:
    """Runs of eight pages for long documents, else one chapter."""
    step = F.when(F.col("page_count") > 16, 8).otherwise(F.greatest(F.lit(1), F.col("page_count"))).cast("bigint")
    last = F.least(F.col("page_count"), F.col("start_page") + F.col("step") - 1)
    spaced = page_counts.withColumn("step", step).filter("page_count > 0")
    runs = spaced.withColumn("start_page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count"), F.col("step"))))
    title = F.when((F.col("start_page") == 1) & (F.col("end_page") == F.col("page_count")), "正文").otherwise(
        F.concat(F.lit("第 "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit(" 页"))
    )
    return runs.withColumn("end_page", last).select("doc", title.alias("title"), "start_page", "end_page")


def normalise_chapters(plan: DataFrame, roled: DataFrame) -> DataFrame:
    """Clamp a chapter plan to content pages, merge equal starts, make ranges contiguous.

    ``plan``: doc, item, title, start_page, end_page, key_terms. Content pages in a range are
    found by two as-of lookups; chapters are ordered per block of pages. Roles are told once and written as rows without text,
    and so are the rows between the lookups: each of the following steps reads its input several times.
    """
    marks = materialise(roled.select("doc", "page_no", "page_count", "role"), "page-roles")
    is_content = (F.col("role") == "content").cast("bigint")
    counts = marks.groupBy("doc").agg(F.max("page_count").alias("page_count"))
    blocked = marks.withColumn("_block", F.coalesce(page_block(), F.lit(0).cast("bigint")))
    content = key_totals(blocked, ["doc"], "_block", {"_content": is_content}).filter("role = 'content' OR _content = 0")
    bounds = content.groupBy("doc").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))
    limits = counts.select("doc", "page_count")

    clamped = (
        plan.join(limits, "doc")
        .withColumn("lo", F.greatest(F.lit(1), F.least(F.col("page_count"), F.col("start_page"))))
        .withColumn("hi", F.greatest(F.col("lo"), F.least(F.col("page_count"), F.col("end_page"))))
        .select("doc", "item", "title", "key_terms", "lo", "hi")
    )
    upward = content.select("doc", (-F.col("page_no")).alias("at"), F.col("page_no").alias("start_page")).withColumn("block", page_block("at"))
    downward = content.select("doc", F.col("page_no").alias("at"), F.col("page_no").alias("end_page")).withColumn("block", page_block("at"))
    first = materialise(
        latest_at(clamped.withColumn("at", -F.col("lo")).withColumn("block", page_block("at")), upward, ["doc"], "block", "at", ["start_page"]), "chapter-starts"
    )
    both = latest_at(
        first.drop("block", "at").withColumn("at", F.col("hi")).withColumn("block", page_block("at")), downward, ["doc"], "block", "at", ["end_page"]
    ).filter((F.col("start_page") <= F.col("hi")) & (F.col("end_page") >= F.col("lo")))

    title = strip(F.regexp_replace(strip("title"), r"^#+", ""))
    terms = F.filter(F.transform(F.coalesce("key_terms", F.array().cast("array<string>")), lambda t: strip(t)), lambda t: t != "")
    tidy = both.withColumn("title", F.when(title == "", "正文").otherwise(title)).withColumn("key_terms", terms)
    items = F.array_sort(F.collect_list(F.struct("end_page", "item", "title", "key_terms")))
    later_terms = F.flatten(F.transform(F.slice("items", F.lit(2), F.size("items")), lambda x: F.concat(F.array(x["title"]), x["key_terms"])))
    merged = materialise(
        tidy.groupBy("doc", "start_page").agg(F.max("end_page").alias("end_page"), items.alias("items"))
        .withColumn("title", F.col("items")[0]["title"])
        .withColumn("key_terms", F.array_distinct(F.concat(F.col("items")[0]["key_terms"], later_terms)))
        .drop("items"), "chapters"
    )
    opening = merged.groupBy("doc").agg(F.min("start_page").alias("opening"))
    followed = neighbour(merged.withColumn("block", page_block("start_page")), ["doc"], "block", ["start_page"], "start_page", "next_start", 1)
    named = unique_titles(followed.join(bounds, "doc").join(opening, "doc")).withColumn(
        "start_page", F.when(F.col("start_page") == F.col("opening"), F.col("first_page")).otherwise(F.col("start_page"))
    )
    ranged = named.withColumn(
        "end_page",
        F.when(F.col("next_start").isNull(), F.col("last_page")).otherwise(F.greatest("start_page", F.col("next_start") - 1)),
    )
    planned = materialise(ranged.select("doc", "title", "start_page", "end_page", F.array_join("key_terms", "|").alias("key_terms")), "chapter-ranges")
    unplanned = fallback_chapters(limits.join(planned.select("doc").distinct(), "doc", "left_anti"))
    return planned.unionByName(unplanned.withColumn("key_terms", F.lit("")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy_parts(sizes: pd.Series) -> pd.Series:
    """Part number of each page from (raw length, stripped length) pairs in page order."""

    def assign(pairs):
        numbers, part, held = [], 1, 0
        for pair in pairs:
            if held and held + pair["raw"] > V.PART_LIMIT:
                part, held = part + 1, pair["raw"]
            elif held:
                held += 2 + pair["bare"]
            else:
                held = pair["bare"]
            numbers.append(part)
        return numbers

    return sizes.map(assign)


def pack_parts(roled: DataFrame) -> DataFrame:
    """Greedy packing of content pages into parts of about 4500 characters.

    Greedy packing is sequential within one document. Only two lengths per page are gathered
    for it; texts are joined per part afterwards, and a part is bounded by its limit.
    """
    block = F.concat(F.lit("<!-- page:"), F.col("page_no").cast("string"), F.lit(" -->\n\n"), F.col("text"))
    blocks = roled.filter("role = 'content'").select("doc", "page_no", block.alias("block"))
    sizes = blocks.select("doc", "page_no", F.length("block").alias("raw"), F.length(strip("block")).alias("bare"))
    gathered = sizes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_no", "raw", "bare"))).alias("pages"))
    numbered = gathered.select(
        "doc", F.explode(F.arrays_zip(F.col("pages")["page_no"].alias("page_no"), _greedy_parts(
            F.transform("pages", lambda p: F.struct(p["raw"].alias("raw"), p["bare"].alias("bare")))
        ).alias("part_no"))).alias("z"),
    ).select("doc", "z.page_no", "z.part_no")
    joined = blocks.join(numbered, ["doc", "page_no"]).groupBy("doc", "part_no").agg(
        ordered_join("\n\n", F.col("page_no"), F.col("block")).alias("joined"), F.count(F.lit(1)).alias("pages")
    )
    # A part opened by overflow keeps its single page as it is; all others are stripped.
    alone = (F.col("part_no") > 1) & (F.col("pages") == 1)
    return joined.select("doc", "part_no", "pages", F.when(alone, F.col("joined")).otherwise(strip("joined")).alias("text"))


def retry_budget(characters: Column, parts: Column) -> Column:
    return F.when((characters >= 14000) | (parts >= 8), 6).when((characters >= 9000) | (parts >= 4), 5).otherwise(4)


def sample_planning_pages(
    roled: DataFrame, whole_up_to: int | None = None, content_samples: int = 34, outline_pages: int | None = None,
    page_chars: tuple[int, int] | None = None, total_chars: int | None = None,
) -> DataFrame:
    """Pages shown to structure planning, with the character budget of each page (null: the whole page).

    By default every page is shown whole. With ``whole_up_to`` longer documents show ``content_samples`` evenly spaced content pages and the outlines
    (of the first ``outline_pages`` only, if given); ``page_chars`` bounds the share of ``total_chars`` that each page gets.
    With limits, roles and excerpts are written once; pages are chosen on rows without text.
    """
    trimmed = F.regexp_replace(strip("text"), r"\n{3,}", "\n\n")
    limited = page_chars is not None and total_chars is not None
    known = roled.dropna(subset=["doc", "page_no"])
    if whole_up_to is None and not limited:
        return known.select("doc", "page_no", "role", F.lit(None).cast("bigint").alias("budget"), trimmed.alias("excerpt"))
    # No budget is above its bound, so no more of a page is kept.
    most = F.substring(trimmed, 1, max(page_chars)) if limited else trimmed
    pages = materialise(known.select("doc", "page_no", "page_count", "role", most.alias("excerpt")), "planning-pages")
    chosen = pages.select("doc", "page_no")
    if whole_up_to is not None:
        long = pages.filter(F.col("page_count") > whole_up_to)
        counts = long.groupBy("doc").agg(F.count_if(F.col("role") == "content").alias("learning")).withColumn("samples", F.least(F.lit(content_samples), F.col("learning")))
        wanted = counts.filter("samples > 0").select(
            "doc", "learning", "samples", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("samples") - 1)).alias("i")
        ).select(
            "doc", (F.bround(F.col("i") * (F.col("learning") - 1) / F.greatest(F.lit(1), F.col("samples") - 1)) + 1).cast("bigint").alias("nth")
        ).distinct()
        content = long.filter("role = 'content'").select("doc", "page_no", page_block().alias("block"))
        spaced = ranked(content, ["doc"], "block", [F.col("page_no")], "nth").join(wanted, ["doc", "nth"])
        early = F.lit(True) if outline_pages is None else F.col("page_no") <= outline_pages
        outline = long.filter((F.col("role") == "outline") & early)
        short = pages.filter(F.col("page_count") <= whole_up_to)
        chosen = spaced.select("doc", "page_no").union(outline.select("doc", "page_no")).union(short.select("doc", "page_no"))
    # Of a known size, so that a short choice goes to the excerpts and not all excerpts to the choice.
    chosen = materialise(chosen.distinct(), "planning-choice")
    if not limited:
        return pages.join(chosen, ["doc", "page_no"]).select("doc", "page_no", "role", F.lit(None).cast("bigint").alias("budget"), "excerpt")
    share = F.greatest(F.lit(page_chars[0]), F.least(F.lit(page_chars[1]), F.floor(F.lit(total_chars) / F.col("shown"))))
    blocked = chosen.withColumn("_block", page_block())
    budgets = key_totals(blocked, ["doc"], "_block", {"shown": F.lit(1).cast("bigint")}).select("doc", "page_no", share.alias("budget"))
    return pages.join(budgets, ["doc", "page_no"]).select(
        "doc", "page_no", "role", "budget", F.substring(F.col("excerpt"), F.lit(1), F.col("budget").cast("int")).alias("excerpt")
    )


def planning_text(samples: DataFrame, total_chars: int | None = None) -> DataFrame:
    """The whole planning input of a document, cut after ``total_chars`` if given, and the number of pages shown in it.

    The text of one document is one value. Blocks of pages are joined first, so the task of a document puts a few long pieces together.
    """
    label = F.when(F.col("role") == "skip", "跳过正文").when(F.col("role") == "outline", "仅结构参考").otherwise("知识正文")
    part = F.concat(F.lit("[PAGE "), F.col("page_no").cast("string"), F.lit(" | "), label, F.lit("]\n"), F.col("excerpt"))
    parts = samples.select("doc", page_block().alias("_block"), "page_no", part.alias("_part"))
    pieces = parts.groupBy("doc", "_block").agg(
        # A block without any text is no piece: an empty one would add a separator.
        F.when(F.count("_part") > 0, ordered_join("\n\n", F.col("page_no"), F.col("_part"))).alias("_piece"), F.count(F.lit(1)).alias("_pages")
    )
    whole = ordered_join("\n\n", F.col("_block"), F.col("_piece"))
    return pieces.groupBy("doc").agg(
        (whole if total_chars is None else F.substring(whole, 1, total_chars)).alias("planning_text"), F.sum("_pages").alias("shown")
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """Pages of a document as one text; the result is one row by definition. A page without text keeps its label."""
    part = F.concat(F.lit("[PAGE "), F.col("page_no").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy("doc").agg(ordered_join("\n\n", F.col("page_no"), part).alias("original_text"))


def sparse_pages(pages: DataFrame) -> DataFrame:
    """Pages with almost no text, routed to bulk or single recognition."""
    sparse = pages.filter(F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) < 12)
    counts = sparse.groupBy(F.col("doc").alias("_doc")).agg(F.count(F.lit(1)).alias("sparse"))
    return sparse.join(counts, F.col("doc").eqNullSafe(F.col("_doc"))).select(
        "doc", "page_no", F.when(F.col("sparse") > 8, "bulk").otherwise("single").alias("route")
    )
