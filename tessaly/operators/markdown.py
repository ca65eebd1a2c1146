"""Cleanup, structure and reading context of Markdown documents.

A document is one row; its blocks, pages and headings are arrays inside that row, so most of
these operators are narrow column expressions without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.functions.text import (
    BLANK, PAGE_ANCHOR, as_column, bare_key, blank_to_null, blocks, clean_heading, compact, contains_any, dollar_math,
    folded_space, let, remove_all, single_spaced, strip, unquoted,
)

IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LEVEL2 = rf"(?md)^##(?!#){BLANK}+(.+?){BLANK}*$"
LEVEL3 = rf"(?md)^###(?!#){BLANK}+(.+?){BLANK}*$"
ANY_HEADING = rf"(?md)^#{{1,4}}{BLANK}+.+?{BLANK}*$"


def found(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def block_key(block: Column) -> Column:
    """Comparison key of a block: comments and blanks removed, lower-cased."""
    return compact(F.regexp_replace(block, r"<!--.*?-->", ""))


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    flag = F.lit(False)
    for prefix in prefixes:
        flag = flag | value.startswith(prefix)
    return flag


def left_stripped(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{BLANK}+", "")


def dedupe_blocks(body: Column) -> Column:
    """Later repeats of long prose blocks dropped; headings, anchors, code and tables stay."""

    def kept(pieces: Column, keys: Column) -> Column:
        def keep(piece: Column, at: Column) -> Column:
            protected = starts_with_any(left_stripped(piece), ("#", "<!-- page:", "```", "|"))
            new = let(F.get(keys, at), lambda key: (F.length(key) < 30) | (F.array_position(keys, key) == at + 1))
            return protected | new

        return F.array_join(F.transform(F.filter(pieces, keep), strip), "\n\n")

    joined = let(
        blocks(strip(body)),
        lambda pieces: let(F.transform(pieces, block_key), lambda keys: kept(pieces, keys)),
    )
    return strip(unquoted(dollar_math(joined)))


def repeated_block_count(body: Column) -> Column:
    """Unprotected long blocks which repeat an earlier unprotected long block."""
    prose = F.filter(
        F.transform(
            F.filter(blocks(body), lambda b: ~starts_with_any(left_stripped(b), ("#", "<!--", "```", "|"))), block_key
        ),
        lambda key: F.length(key) >= 30,
    )
    return F.size(prose) - F.size(F.array_distinct(prose))


def squeezed_closing() -> list[str]:
    return [w.replace(" ", "") for w in V.CLOSING_TERMS]


def drop_closing_pages(body: Column) -> Column:
    """Pages holding only a closing phrase vanish; elsewhere short closing blocks do."""
    words = squeezed_closing()
    numbers = found(body, PAGE_ANCHOR, 1)

    def closing_block(block: Column) -> Column:
        return let(bare_key(block), lambda key: (F.length(key) <= 52) & contains_any(key, words))

    def only_closing(segment: Column) -> Column:
        return let(
            bare_key(F.regexp_replace(segment, IMAGE, "")),
            lambda key: contains_any(key, words) & (F.length(remove_all(key, words)) <= 8),
        )

    def page(number: Column, segment: Column) -> Column:
        kept = F.filter(blocks(segment), lambda b: ~closing_block(b))
        return F.when(only_closing(segment), "").otherwise(
            F.concat(F.lit("<!-- page:"), number, F.lit(" -->"), F.array_join(kept, "\n\n"))
        )

    cleaned = let(
        F.split(body, PAGE_ANCHOR, -1),
        lambda segments: F.concat(
            F.get(segments, F.lit(0)),
            F.array_join(F.zip_with(numbers, F.slice(segments, F.lit(2), F.size(segments)), page), ""),
        ),
    )
    return F.when(F.size(numbers) == 0, body).otherwise(strip(cleaned))


def heading_outline(body: Column) -> Column:
    """Level-2 headings in order, or the default body title."""
    headings = F.transform(found(body, rf"(?md)^##{BLANK}+(.+?){BLANK}*$", 1), strip)
    return F.when(F.size(headings) == 0, F.array(F.lit("正文"))).otherwise(headings)


def local_issues(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Structural problems of reconstructed documents, one row each. ``plan``: id, chapter_title."""
    missing = (
        docs.join(plan, "id")
        .filter(~F.col("body").contains(F.concat(F.lit("## "), F.col("chapter_title"))))
        .select("id", "chapter_title", F.lit("缺少规划中的章节标题").alias("problem"))
    )
    whole = F.lit("全文").alias("chapter_title")
    unanchored = docs.filter(~F.col("body").contains("<!-- page:")).select("id", whole, F.lit("缺少页码锚点").alias("problem"))
    delimiters = docs.filter(F.col("body").rlike(r"\\\(|\\\[")).select("id", whole, F.lit("仍有非统一数学定界符").alias("problem"))
    return missing.unionByName(unanchored).unionByName(delimiters)


def _chapter_pattern(title: Column) -> Column:
    return F.concat(
        F.lit(rf"(?msd)(^##{BLANK}+"), F.lit(r"\Q"), title, F.lit(r"\E"), F.lit(rf"{BLANK}*$\n)(.*?)(?=^##{BLANK}+|\z)")
    )


def chapter_body(body: Column, title: Column) -> Column:
    """Text between a level-2 heading and the next one."""
    return strip(F.call_function("regexp_extract", body, _chapter_pattern(title), F.lit(2)))


def replace_chapter(body: Column, title: Column, repaired: Column) -> Column:
    """First chapter of that title gets a new body; other text is untouched."""
    whole = F.call_function("regexp_extract", body, _chapter_pattern(title), F.lit(0))
    head = F.call_function("regexp_extract", body, _chapter_pattern(title), F.lit(1))
    at = F.call_function("regexp_instr", body, _chapter_pattern(title))
    new = F.concat(head, F.lit("\n"), strip(repaired), F.lit("\n\n"))
    rebuilt = F.concat(F.substring(body, F.lit(1), at - 1), new, F.substring(body, at + F.length(whole), F.length(body)))
    return F.when(at == 0, body).otherwise(rebuilt)


def is_collection(body: Column, page_count: Column, min_pages: int = 80, min_characters: int = 100_000) -> Column:
    chapters, sections = F.size(found(body, LEVEL2, 1)), F.size(found(body, LEVEL3, 1))
    structured = (chapters >= 2) | ((chapters == 1) & (sections >= 4))
    return structured & ((page_count >= min_pages) | (F.length(body) >= min_characters))


def _pieces(text: Column, pattern: str) -> Column:
    """Text cut before every heading; the text before the first heading is piece 0."""
    return F.split(text, rf"(?md)(?={pattern})", -1)


CHAPTER_CUT, UNIT_CUT = rf"^##(?!#){BLANK}+.", rf"^###(?!#){BLANK}+."


def split_units(docs: DataFrame) -> DataFrame:
    """Chapters (level 2) and their units (level 3) in order, one row per unit.

    Text before the first chapter joins the first chapter, text before the first unit of a
    chapter joins that unit. A chapter without units is one unit of its own title.
    """

    def chapter_list(cuts: Column) -> Column:
        headed = F.get(cuts, F.lit(0)).rlike(rf"(?d)^##(?!#){BLANK}+.")
        chapters = F.when(headed, cuts).otherwise(F.slice(cuts, F.lit(2), F.size(cuts)))
        preamble = F.when(headed, F.lit("")).otherwise(strip(F.get(cuts, F.lit(0))))
        return F.transform(
            chapters,
            lambda text, at: F.struct(F.when(at == 0, preamble).otherwise("").alias("pre"), text.alias("text")),
        )

    chapter_rows = (
        docs.select("*", F.posexplode(let(_pieces(strip("body"), CHAPTER_CUT), chapter_list)).alias("chapter_no", "_c"))
        .withColumn("group_title", clean_heading(F.regexp_extract("_c.text", LEVEL2, 1)))
        .withColumn("_own", strip(F.regexp_replace("_c.text", rf"(?d)^##(?!#){BLANK}+[^\n]+", "")))
        .withColumn(
            "_text",
            F.when(F.col("_c.pre") != "", strip(F.concat("_c.pre", F.lit("\n\n"), "_own"))).otherwise(F.col("_own")),
        )
    )
    has_units = F.size(found(F.col("_text"), LEVEL3, 1)) > 0

    def unit_list(parts: Column) -> Column:
        first_is_unit = F.get(parts, F.lit(0)).rlike(rf"(?d)^###(?!#){BLANK}+.")
        prefix = F.when(first_is_unit, F.lit("")).otherwise(strip(F.get(parts, F.lit(0))))
        own = F.when(first_is_unit, parts).otherwise(F.slice(parts, F.lit(2), F.size(parts)))

        def listed(before: Column) -> Column:
            def unit(part: Column, at: Column) -> Column:
                led = F.when((at == 0) & (before != ""), F.concat(before, F.lit("\n\n"), strip(part))).otherwise(strip(part))
                return F.struct(clean_heading(F.regexp_extract(part, LEVEL3, 1)).alias("title"), led.alias("text"))

            return F.transform(own, unit)

        return let(prefix, listed)

    whole = F.array(F.struct(F.col("group_title").alias("title"), F.col("_text").alias("text")))
    units = F.when(has_units, let(_pieces(F.col("_text"), UNIT_CUT), unit_list)).otherwise(whole)
    keep = [c for c in docs.columns if c != "body"]
    return chapter_rows.select(*keep, "chapter_no", "group_title", units.alias("units"), has_units.alias("has_units"))


SECTIONS = "array<struct<title:string,number:string,kind:string,units:array<int>>>"


def _headline(title: Column) -> Column:
    """What a title says of its section: kind, section number and the text to open it with."""
    says = lambda pattern: title.rlike("(?U)" + pattern)
    part = lambda pattern, group: F.regexp_extract(title, "(?U)" + pattern, group)
    number = lambda pattern: F.concat(part(pattern, 1), F.lit("."), part(pattern, 2))

    def line(kind: str, own: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), own.cast("string").alias("number"), text.alias("text"))

    exercise, deeper = number(V.NUMBERED_EXERCISE), number(V.SUBSECTION)
    return (
        F.when(says(V.NUMBERED_EXERCISE), line("exercise", exercise, F.concat(F.lit("习题 "), exercise)))
        .when(says(V.CHAPTER_EXERCISE), line("exercise", F.lit(None), title))
        .when(says(V.MAJOR_SECTION), line("numbered", number(V.MAJOR_SECTION), title))
        .when(says(V.SUBSECTION), line("deeper", deeper, strip(F.concat(deeper, F.lit(" "), part(V.SUBSECTION, 3)))))
        .otherwise(line("plain", F.lit(None), title))
    )


def _placed(sections: Column, unit: Column) -> Column:
    """Sections after one more unit, which joins the last of them or opens its own."""
    head = unit["head"]

    def after(last: Column) -> Column:
        waiting = F.coalesce(last["kind"] == "provisional", F.lit(False))
        same = F.coalesce(last["number"] == head["number"], F.lit(False))
        in_exercise = F.coalesce(last["kind"] == "exercise", F.lit(False))
        loose = (last["kind"] == "section") & last["number"].isNull()
        joins = (
            F.when(head["kind"] == "numbered", same & (last["kind"] == "section"))
            .when(head["kind"] == "deeper", waiting | (same & ~in_exercise))
            .when(head["kind"] == "plain", last.isNotNull() & ~loose & (~in_exercise | head["text"].startswith("习题")))
            .otherwise(F.lit(False))
        )
        named = waiting & (head["kind"] == "deeper")
        kind = F.when(head["kind"] == "exercise", "exercise").when(in_exercise & (head["kind"] == "plain"), "provisional").otherwise("section")
        opened = F.struct(head["text"].alias("title"), head["number"].alias("number"), kind.alias("kind"), F.array(unit["at"]).alias("units"))
        grown = F.struct(
            F.when(named, F.concat(head["number"], F.lit(" "), last["title"])).otherwise(last["title"]).alias("title"),
            F.when(named, head["number"]).otherwise(last["number"]).alias("number"),
            F.when(named, "section").otherwise(last["kind"]).alias("kind"),
            F.concat(last["units"], F.array(unit["at"])).alias("units"),
        )
        before = F.slice(sections, F.lit(1), F.greatest(F.lit(0), F.size(sections) - 1))
        return F.when(joins, F.concat(before, F.array(grown))).otherwise(F.concat(sections, F.array(opened))).cast(SECTIONS)

    return let(F.try_element_at(sections, F.lit(-1)), after)


def merge_major_sections(units: DataFrame) -> DataFrame:
    """Units of a chapter joined into complete x.y sections by one fold over their titles. A section holds the places of
    its units; texts are joined at the end. A chapter is part of one document row."""
    marked = F.transform("units", lambda u, at: F.struct(at.alias("at"), _headline(u["title"]).alias("head")))
    sections = F.aggregate(marked, F.array().cast(SECTIONS), _placed)

    def with_text(section: Column) -> Column:
        texts = F.transform(section["units"], lambda at: F.get(F.col("units"), at)["text"])
        return F.struct(section["title"].alias("title"), F.array_join(texts, "\n\n").alias("text"))

    merged = F.when(F.col("has_units"), F.transform(sections, with_text)).otherwise(F.col("units"))
    keep = [c for c in units.columns if c not in ("units", "has_units")]
    return units.select(*keep, F.posexplode(merged).alias("section_no", "_s")).select(
        *keep, "section_no", F.col("_s.title").alias("title"), F.col("_s.text").alias("text")
    )


def section_seed(group_title: Column | str, title: Column | str) -> Column:
    """Identity of a section: its group and its title without a pack-size suffix."""
    bare = strip(F.regexp_replace(as_column(title), rf"{BLANK}+等{BLANK}+[0-9]+{BLANK}+节$", ""))
    return F.concat(folded_space(group_title), F.lit("\n"), folded_space(bare))


def with_section_keys(sections: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stable section key from the seed and its running number. ``keys`` is the document key;
    sections of a document come from one row."""
    nth = F.row_number().over(Window.partitionBy(*keys, "seed").orderBy(order))
    return (
        sections.withColumn("seed", section_seed("group_title", "title"))
        .withColumn("occurrence", nth)
        .withColumn("section_key", F.substring(F.sha1(F.concat_ws("\n", "seed", F.col("occurrence").cast("string"))), 1, 20))
        .drop("seed")
    )


def build_sections(docs: DataFrame, min_pages: int = 80, min_characters: int = 100_000) -> DataFrame:
    """Study sections of the documents which qualify as collections (``page_count`` given)."""
    long = docs.filter(is_collection(F.col("body"), F.col("page_count"), min_pages, min_characters))
    merged = merge_major_sections(split_units(long)).withColumn("_text", strip("text"))
    markdown = strip(F.concat(F.lit("# "), "title", F.lit("\n\n## "), "group_title", F.lit("\n\n"), "_text"))
    place = Window.partitionBy("id").orderBy("chapter_no", "section_no")
    total = F.count(F.lit(1)).over(Window.partitionBy("id"))
    placed = (
        merged.withColumn("markdown", markdown)
        .withColumn("sort_order", F.row_number().over(place))
        .withColumn("_sections", total)
        .filter(F.col("_sections") >= 2)
    )
    pages = F.transform(found(F.col("markdown"), PAGE_ANCHOR, 1), lambda p: p.cast("int"))
    return with_section_keys(placed, ["id"], "sort_order").select(
        "id", "section_key", "title", "group_title", "markdown", "sort_order",
        F.array_min(pages).alias("source_start_page"), F.array_max(pages).alias("source_end_page"),
    )


def navigation_rows(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with a header row wherever the group changes in the ordered list (runs).

    ``sections``: keys, id, title, group_title, sort_order. Sections of one parent are cut
    from one document row, so a parent's window is bounded by that row.
    """
    place = Window.partitionBy(*keys).orderBy("sort_order", "id")
    group = F.coalesce(blank_to_null(F.col("group_title")), F.lit("其他内容"))
    marked = sections.withColumn("group", group).withColumn("_before", F.lag("group").over(place))
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("group"))
    header = F.struct(F.lit(1).alias("level"), F.col("group").alias("label"), F.lit(None).cast("bigint").alias("document_id"))
    item = F.struct(F.lit(2).alias("level"), F.col("title").alias("label"), F.col("id").cast("bigint").alias("document_id"))
    rows = marked.withColumn("run", F.sum(changed.cast("int")).over(place)).withColumn(
        "_rows", F.when(changed, F.array(header, item)).otherwise(F.array(item))
    )
    listed = rows.select(*keys, "sort_order", "id", "run", F.explode("_rows").alias("_r")).select(
        *keys, "sort_order", "id", "run", "_r.*"
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("sort_order", "id", "level"))
    return listed.withColumn("position", number).select(*keys, "position", "run", "level", "label", "document_id")


def table_of_contents(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """Text contents of a parent: its title, group headings at run starts, page labels, page total.

    ``sections``: doc, title, group_title, sort_order, start_page, end_page; ``titles``: doc, doc_title, page_count.
    """
    place = Window.partitionBy("doc").orderBy("sort_order")
    before = F.lag("group_title").over(place)
    pages = F.when(
        F.col("start_page").isNotNull(),
        F.concat(F.lit("（第 "), F.col("start_page").cast("string"), F.lit("–"), F.col("end_page").cast("string"), F.lit(" 页）")),
    ).otherwise("")
    line = F.concat(F.lit("- "), "title", pages)
    headed = F.when(F.col("_b").isNull() | (F.col("_b") != F.col("group_title")), F.concat(F.lit("## "), "group_title", F.lit("\n\n"), line)).otherwise(line)
    body = (
        sections.withColumn("_b", before)
        .groupBy("doc")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", headed.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    )
    intro = F.concat(F.lit("# "), "doc_title", F.lit("\n\n本资料已按章节整理为若干个可独立学习的小节文档。\n\n"), "body")
    total = F.when(F.col("page_count") > 0, F.concat(F.lit("\n\n原始资料共 "), F.col("page_count").cast("string"), F.lit(" 页。"))).otherwise("")
    return titles.join(body, "doc").select("doc", strip(F.concat(intro, total)).alias("toc"))


def repack(children: DataFrame) -> DataFrame:
    """Children of a parent back into one text, group headings put back at run starts."""
    place = Window.partitionBy("parent").orderBy("sort_order", "id")
    group = F.coalesce(blank_to_null(F.col("group_title")), F.lit("未命名章节"))
    unwrapped = strip(F.regexp_replace("markdown", rf"(?s)\A#(?!#){BLANK}+.*?\n+##(?!#){BLANK}+.*?\n+", ""))
    marked = children.withColumn("group", group).withColumn("_before", F.lag("group").over(place)).withColumn("body", unwrapped)
    header = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("group")), F.concat(F.lit("## "), "group"))
    part = F.concat_ws("\n\n", header, blank_to_null(F.col("body")))
    pieces = F.filter(
        F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "id", part.alias("part")))), lambda x: x["part"]),
        lambda p: p != "",
    )
    return marked.groupBy("parent").agg(F.array_join(pieces, "\n\n").alias("body"))


def paragraph_context(body: Column, selected: Column) -> Column:
    """The block holding the selection with one block on each side, else the selection."""
    parts = F.filter(F.transform(F.split(body, rf"\n{BLANK}*\n", -1), strip), lambda b: b != "")

    def around(blocks_: Column, probe: Column) -> Column:
        hits = F.transform(blocks_, lambda b: (probe != "") & single_spaced(b).contains(probe))
        return let(
            F.array_position(hits, F.lit(True)).cast("int"),
            lambda at: F.when(at == 0, selected).otherwise(
                F.array_join(F.slice(blocks_, F.greatest(F.lit(1), at - 1), F.when(at == 1, 2).otherwise(3)), "\n\n")
            ),
        )

    return let(parts, lambda found_: let(strip(single_spaced(selected)), lambda probe: around(found_, probe)))


def _position(body: Column, selected: Column) -> Column:
    """1-based place of a selection: verbatim, else with any blanks between its words; 0 if absent."""
    probe = strip(single_spaced(selected))
    words = F.filter(F.split(probe, rf"{BLANK}+", -1), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), rf"{BLANK}+")
    loose = F.when(pattern == "", 0).otherwise(F.call_function("regexp_instr", body, pattern))
    exact = F.call_function("instr", body, selected)
    return F.when(exact > 0, exact).otherwise(loose)


def section_context(body: Column, selected: Column) -> Column:
    """From the nearest heading at or before the selection to the next of the same or a higher level."""
    level = lambda piece: F.length(F.regexp_extract(piece, rf"^(#{{1,4}}){BLANK}+.", 1))
    placed = F.aggregate(
        F.split(body, rf"(?md)(?=^#{{1,4}}{BLANK}+.)", -1),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start:int,level:int>>").alias("seen")),
        lambda acc, piece: F.struct(
            (acc["next"] + F.length(piece)).alias("next"),
            F.concat(acc["seen"], F.array(F.struct(acc["next"].alias("start"), level(piece).alias("level")))).alias("seen"),
        ),
        lambda acc: F.filter(acc["seen"], lambda h: h["level"] > 0),
    )

    def from_heading(headings: Column, own: Column) -> Column:
        after = F.filter(headings, lambda h: (h["start"] > own["start"]) & (h["level"] <= own["level"]))
        end = F.coalesce(F.get(after, F.lit(0))["start"], F.length(body) + 1)
        return F.substring(body, own["start"], end - own["start"])

    def at_place(at: Column) -> Column:
        cut = let(
            placed,
            lambda headings: let(
                F.filter(headings, lambda h: h["start"] <= at),
                lambda before: F.when(F.size(before) == 0, body).otherwise(
                    let(F.get(before, F.size(before) - 1), lambda own: from_heading(headings, own))
                ),
            ),
        )
        return F.when(at == 0, paragraph_context(body, selected)).otherwise(cut)

    return let(_position(body, selected), at_place)


def span_context(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Text of an anchored range with 120 characters on each side. Invalid ranges are flagged."""
    start, end = F.col("anchor_start"), F.col("anchor_end")
    text = F.substring(F.col("body"), start + 1, end - start)
    valid = (start >= 0) & (end > start) & (strip(text) != "")
    return docs.join(spans, "id").select(
        "id", "anchor_start", "anchor_end", F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(valid, strip(text)).alias("selected_text"),
        F.when(valid, F.substring(F.col("body"), F.greatest(F.lit(0), start - 120) + 1, start - F.greatest(F.lit(0), start - 120))).alias("prefix"),
        F.when(valid, F.substring(F.col("body"), end + 1, F.lit(120))).alias("suffix"),
    )


def outline_tree(docs: DataFrame) -> DataFrame:
    """Headings and bullets of a document as a tree: depth and parent position of each item.

    The stack of open items is an array inside the fold of one document row.
    """
    item = lambda line: F.struct(
        F.when(line.rlike(r"^#{1,6}\s+.+"), F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1)) - 1)
        .when(line.rlike(r"^\s*[-*+]\s+.+"), F.floor(F.length(F.regexp_extract(line, r"^(\s*)[-*+]\s+", 1)) / 2) + 1)
        .cast("int").alias("depth"),
        F.replace(
            F.when(line.rlike(r"^#{1,6}\s+.+"), F.regexp_extract(line, r"^#{1,6}\s+(.+)", 1))
            .otherwise(F.regexp_extract(line, r"^\s*[-*+]\s+(.+)", 1)),
            F.lit("**"), F.lit(""),
        ).alias("label"),
    )
    items = F.filter(F.transform(F.split("body", r"\r?\n", -1), item), lambda i: i["depth"].isNotNull())
    state = F.struct(
        F.array().cast("array<int>").alias("open"),
        F.array().cast("array<struct<no:int,parent:int,level:int,label:string>>").alias("out"),
    )

    def step(acc: Column, entry: Column) -> Column:
        kept = F.slice(acc["open"], 1, F.least(F.size(acc["open"]), entry["depth"]))
        no = F.size(acc["out"])
        parent = F.when(F.size(kept) > 0, F.element_at(kept, -1))
        row = F.struct(no.alias("no"), parent.alias("parent"), F.size(kept).alias("level"), entry["label"].alias("label"))
        return F.struct(F.concat(kept, F.array(no)).alias("open"), F.concat(acc["out"], F.array(row)).alias("out"))

    return docs.select("id", F.inline(F.aggregate(items, state, step)["out"]))


def protected_tokens(body: Column) -> list[Column]:
    """Formulas, citations and capitalised terms which a rewrite must not touch."""
    formulas = found(body, r"(?s)\$\$.*?\$\$|\$.*?\$")
    citations = found(body, r"\[[0-9,\-\s]+\]|\([^)]*\b(?:19|20)\d{2}[^)]*\)")
    terms = F.array_sort(F.array_distinct(found(body, r"(?U)\b[A-Z][A-Za-z0-9+\-]{1,30}\b")))
    return [formulas.alias("formulas"), citations.alias("citations"), terms.alias("terms")]


def readability_counts(body: Column) -> tuple[Column, Column]:
    """Quoted lines and extracted-image references."""
    quotes = F.size(found(body, r"(?md)^\s{0,3}>"))
    images = ((F.length(body) - F.length(F.replace(body, F.lit("asset://"), F.lit("")))) / 8).cast("bigint")
    return quotes, images


