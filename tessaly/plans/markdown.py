"""Queries over Markdown documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.functions import text as X
from tessaly.operators import markdown as M
from tessaly.plans.registry import query
from tessaly.plans.views import WS, any_sql, compact_sql, key_sql, spaced_sql, strip_sql, view, view_sql
from tessaly.session import table

MD = f"WITH {view_sql('markdown')}"
CLOSING = [w.replace(" ", "") for w in V.CLOSING_TERMS]
NL2 = "chr(10) || chr(10)"


def heading_sql(expr: str) -> str:
    return f"coalesce(nullif({strip_sql(f'''regexp_replace({expr}, '{WS}+#+{WS}*$', '')''')}, ''), '未命名章节')"


def folded_sql(expr: str) -> str:
    return f"replace(lower({strip_sql(spaced_sql(expr))}), 'ß', 'ss')"


def block_key_sql(expr: str) -> str:
    return compact_sql(f"regexp_replace({expr}, '<!--.*?-->', '', 'g')")


def cleaned_sql(expr: str) -> str:
    math = rf"regexp_replace(regexp_replace({expr}, '(?s)\\\((.+?)\\\)', '$\1$', 'g'), '(?s)\\\[(.+?)\\\]', '$$\1$$', 'g')"
    return strip_sql(f"regexp_replace({math}, '(?m)^[ \\t]*>+[ \\t]?', '', 'g')")


def opens_sql(expr: str, prefixes) -> str:
    left = f"regexp_replace({expr}, '^{WS}+', '')"
    return "(" + " OR ".join(f"starts_with({left}, '{p}')" for p in prefixes) + ")"


DEDUPED = rf"""pieces AS (SELECT id, unnest(bs) AS block, unnest(range(len(bs))) AS pos FROM (SELECT id, string_split_regex({strip_sql('body')}, '\n{{2,}}') AS bs FROM markdown)),
    keyed AS (SELECT id, block, pos, {block_key_sql('block')} AS k, {opens_sql('block', ('#', '<!-- page:', '```', '|'))} AS protected FROM pieces),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY pos) AS nth FROM keyed) WHERE nth = 1 OR protected OR len(k) < 30),
    deduped AS (SELECT id, {cleaned_sql(f"string_agg({strip_sql('block')}, {NL2} ORDER BY pos)")} AS body FROM kept GROUP BY id)"""


@query("w2_dedupe_blocks", f"{MD}, {DEDUPED} SELECT id, body FROM deduped")
def deduped(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("id", M.dedupe_blocks(F.col("body")).alias("body"))


REMOVED = "{0}"
for _word in CLOSING:
    REMOVED = f"replace({REMOVED}, '{_word}', '')"
IMAGELESS = key_sql(r"regexp_replace(segs[i + 1], '!\[[^\]]*\]\([^)]*\)', '', 'g')")
SPLIT_PAGES = r"""SELECT id, body, string_split_regex(body, '(?i)<!--\s*page\s*:\s*\d+\s*-->') AS segs, regexp_extract_all(body, '(?i)<!--\s*page\s*:\s*(\d+)\s*-->', 1) AS nums FROM {0}"""


def closing_sql(source: str) -> str:
    page = rf"""CASE WHEN {any_sql(IMAGELESS, CLOSING)} AND len({REMOVED.format(IMAGELESS)}) <= 8 THEN ''
      ELSE concat('<!-- page:', nums[i], ' -->', array_to_string(list_filter(string_split_regex(segs[i + 1], '\n{{2,}}'),
        lambda b: NOT (len({key_sql('b')}) <= 52 AND {any_sql(key_sql('b'), CLOSING)})), {NL2})) END"""
    return f"""SELECT id, CASE WHEN len(nums) = 0 THEN body ELSE {strip_sql(f"concat(segs[1], array_to_string(list_transform(range(1, len(nums) + 1), lambda i: {page}), ''))")} END AS body
      FROM ({SPLIT_PAGES.format(source)})"""


@query("d9_drop_closing_pages", f"{MD} {closing_sql('markdown')}")
def closing(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("id", M.drop_closing_pages(F.col("body")).alias("body"))


OUTLINE = f"""outlines AS (SELECT id, body, CASE WHEN len(hs) = 0 THEN ['正文'] ELSE list_transform(hs, lambda h: {strip_sql('h')}) END AS hs
    FROM (SELECT id, body, regexp_extract_all(body, '(?m)^##{WS}+(.+?){WS}*$', 1) AS hs FROM markdown))"""


@query("d10_heading_outline", f"{MD}, {OUTLINE} SELECT id, hs[1] AS title, array_to_string(hs[2:], '|') AS key_terms FROM outlines")
def outline(spark, sf_dir):
    heads = view(spark, sf_dir, "markdown").select("id", M.heading_outline(F.col("body")).alias("hs"))
    return heads.select("id", F.col("hs")[0].alias("title"), F.array_join(F.slice("hs", F.lit(2), F.size("hs")), "|").alias("key_terms"))


PLAN_SQL = "plan AS (SELECT id, hs[1] AS chapter_title FROM outlines UNION ALL SELECT id, concat('Part ', id % 9) FROM outlines)"


@query("d11_local_issues", rf"""{MD}, {OUTLINE}, {PLAN_SQL}
    SELECT id, chapter_title, '缺少规划中的章节标题' AS problem FROM markdown JOIN plan USING (id) WHERE NOT contains(body, concat('## ', chapter_title))
    UNION ALL SELECT id, '全文', '缺少页码锚点' FROM markdown WHERE NOT contains(body, '<!-- page:')
    UNION ALL SELECT id, '全文', '仍有非统一数学定界符' FROM markdown WHERE contains(body, '\(') OR contains(body, '\[')""")
def issues(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", "body")
    first = docs.select("id", M.heading_outline(F.col("body"))[0].alias("chapter_title"))
    other = docs.select("id", F.concat(F.lit("Part "), (F.col("id") % 9).cast("string")))
    return M.local_issues(docs, first.union(other))


CHAPTER_CUT = f"string_split(regexp_replace(body, '(?m)^(##{WS}+.)', chr(1) || '\\1', 'g'), chr(1))"


@query("d12_chapter_body", rf"""{MD}, {OUTLINE},
    cut AS (SELECT id, body, hs[1] AS title, {CHAPTER_CUT} AS cs FROM outlines),
    matched AS (SELECT *, list_position(list_transform(cs, lambda c: regexp_matches(c, '^##{WS}+[^\n]*\n') AND {strip_sql(f"regexp_extract(c, '^##{WS}+([^\\n]*)', 1)")} = title), true) AS pos FROM cut),
    texts AS (SELECT *, CASE WHEN pos > 0 THEN {strip_sql("regexp_replace(cs[pos], '^[^\\n]*\\n?', '')")} ELSE '' END AS chapter FROM matched)
    SELECT id, title, chapter, CASE WHEN pos > 0 THEN concat(array_to_string(cs[1:pos - 1], ''), regexp_extract(cs[pos], '^[^\n]*{WS}*\n'), chr(10), 'repaired ', id, {NL2}, array_to_string(cs[pos + 1:], ''))
      ELSE body END AS repaired FROM texts""")
def chapter(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", "body", M.heading_outline(F.col("body"))[0].alias("title"))
    new = F.concat(F.lit("repaired "), F.col("id").cast("string"))
    return docs.select(
        "id", "title", M.chapter_body(F.col("body"), F.col("title")).alias("chapter"),
        M.replace_chapter(F.col("body"), F.col("title"), new).alias("repaired"),
    )


LEVELS = f"len(regexp_extract_all(body, '(?m)^##{WS}+(.+?){WS}*$')) AS n2, len(regexp_extract_all(body, '(?m)^###{WS}+(.+?){WS}*$')) AS n3"


@query("d13_is_collection", f"""{MD} SELECT id, CAST((n2 >= 2 OR (n2 = 1 AND n3 >= 4)) AND (id % 40 >= 30 OR len(body) >= 3000) AS BIGINT) AS is_collection
    FROM (SELECT id, body, {LEVELS} FROM markdown)""")
def collections(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown")
    return docs.select("id", M.is_collection(F.col("body"), F.col("id") % 40, 30, 3000).alias("is_collection"))


UNITS = rf"""srcs AS (SELECT id, {strip_sql('body')} AS body FROM markdown),
    cut AS (SELECT id, CASE WHEN regexp_matches(cs[1], '^##{WS}+.') THEN '' ELSE {strip_sql('cs[1]')} END AS pre,
        CASE WHEN regexp_matches(cs[1], '^##{WS}+.') THEN cs ELSE cs[2:] END AS cs FROM (SELECT id, {CHAPTER_CUT} AS cs FROM srcs)),
    chapters AS (SELECT id, pre, unnest(cs) AS c, unnest(range(len(cs))) AS chapter_no FROM cut),
    texts AS (SELECT id, chapter_no, {heading_sql(strip_sql(f"regexp_extract(c, '^##{WS}+([^\\n]+)', 1)"))} AS group_title,
        {strip_sql(f"concat(CASE WHEN chapter_no = 0 AND pre <> '' THEN pre || {NL2} ELSE '' END, {strip_sql(f'''regexp_replace(c, '^##{WS}+[^{chr(92)}n]+', '')''')})")} AS body FROM chapters),
    ucut AS (SELECT id, chapter_no, group_title, body, string_split(regexp_replace(body, '(?m)^(###{WS}+.)', chr(1) || '\1', 'g'), chr(1)) AS us FROM texts),
    upre AS (SELECT *, CASE WHEN regexp_matches(us[1], '^###{WS}+.') THEN '' ELSE {strip_sql('us[1]')} END AS upre,
        CASE WHEN regexp_matches(us[1], '^###{WS}+.') THEN us ELSE us[2:] END AS vs FROM ucut),
    units AS (SELECT id, chapter_no, group_title, 0 AS unit_no, group_title AS title, body AS text FROM upre WHERE len(vs) = 0
      UNION ALL SELECT id, chapter_no, group_title, unit_no, {heading_sql(strip_sql(f"regexp_extract(u, '^###{WS}+([^\\n]+)', 1)"))},
        concat(CASE WHEN unit_no = 0 AND upre <> '' THEN upre || {NL2} ELSE '' END, {strip_sql('u')})
        FROM (SELECT id, chapter_no, group_title, upre, unnest(vs) AS u, unnest(range(len(vs))) AS unit_no FROM upre WHERE len(vs) > 0))"""


@query("d14_split_units", f"{MD}, {UNITS} SELECT * FROM units")
def units(spark, sf_dir):
    rows = M.split_units(view(spark, sf_dir, "markdown").select("id", "body"))
    return rows.select("id", "chapter_no", "group_title", F.posexplode("units").alias("unit_no", "u")).select(
        "id", "chapter_no", "group_title", "unit_no", "u.title", "u.text"
    )


@query("d15_merge_major_sections")
def merged_sections(spark, sf_dir):
    return M.merge_major_sections(M.split_units(view(spark, sf_dir, "markdown").select("id", "body")))


def sections(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", "body", (F.col("id") % 40).alias("page_count"))
    return M.build_sections(docs, 30, 3000)


@query("d16_build_sections")
def built_sections(spark, sf_dir):
    return sections(spark, sf_dir)


SECTION_ROWS = f"""rows_in AS (SELECT id AS doc, chapter_no, unit_no, title, group_title, text, row_number() OVER (PARTITION BY id ORDER BY chapter_no, unit_no) AS sort_order FROM units)"""


def unit_rows(spark, sf_dir):
    """One section per unit, in document order."""
    from pyspark.sql import Window

    return units(spark, sf_dir).withColumn(
        "sort_order", F.row_number().over(Window.partitionBy("id").orderBy("chapter_no", "unit_no"))
    )


@query("w3_section_occurrence_key", f"""{MD}, {UNITS}, {SECTION_ROWS},
    seeded AS (SELECT *, concat({folded_sql('group_title')}, chr(10), {folded_sql(strip_sql(f"regexp_replace(title, '{WS}+等{WS}+[0-9]+{WS}+节$', '')"))}) AS seed FROM rows_in)
    SELECT doc, sort_order, occurrence, substr(sha1(concat(seed, chr(10), occurrence)), 1, 20) AS section_key
    FROM (SELECT *, row_number() OVER (PARTITION BY doc, seed ORDER BY sort_order) AS occurrence FROM seeded)""")
def keyed_sections(spark, sf_dir):
    return M.with_section_keys(unit_rows(spark, sf_dir), ["id"], "sort_order").select(
        F.col("id").alias("doc"), "sort_order", "occurrence", "section_key"
    )


RUNS = """grouped AS (SELECT doc, sort_order, title, coalesce(nullif(group_title, ''), '其他内容') AS grp FROM rows_in),
    flagged AS (SELECT *, lag(grp) OVER (PARTITION BY doc ORDER BY sort_order) IS DISTINCT FROM grp AS changed FROM grouped),
    runs AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY doc ORDER BY sort_order) AS run FROM flagged)"""


@query("w7_navigation_groups", f"""{MD}, {UNITS}, {SECTION_ROWS}, {RUNS},
    listed AS (SELECT doc, sort_order, run, 1 AS level, grp AS label, NULL AS document_id FROM runs WHERE changed
      UNION ALL SELECT doc, sort_order, run, 2, title, doc * 100000 + sort_order FROM runs)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY sort_order, level) AS position, CAST(run AS BIGINT) AS run, level, label, document_id FROM listed""")
def navigation(spark, sf_dir):
    rows = unit_rows(spark, sf_dir).select(
        F.col("id").alias("doc"), (F.col("id") * 100000 + F.col("sort_order")).alias("id"), "title", "group_title", "sort_order"
    )
    return M.navigation_rows(rows, ["doc"])


@query("d17_toc", rf"""{MD}, {UNITS}, {SECTION_ROWS},
    paged AS (SELECT *, CASE WHEN sort_order % 3 > 0 THEN concat('（第 ', sort_order, '–', sort_order + 2, ' 页）') ELSE '' END AS label,
      lag(group_title) OVER (PARTITION BY doc ORDER BY sort_order) IS DISTINCT FROM group_title AS changed FROM rows_in),
    body AS (SELECT doc, string_agg(concat(CASE WHEN changed THEN concat('## ', group_title, {NL2}) ELSE '' END, '- ', title, label), chr(10) ORDER BY sort_order) AS b FROM paged GROUP BY doc)
    SELECT doc, concat('# Doc ', doc, {NL2}, '本资料已按章节整理为若干个可独立学习的小节文档。', {NL2}, b,
      CASE WHEN doc % 40 > 0 THEN concat({NL2}, '原始资料共 ', doc % 40, ' 页。') ELSE '' END) AS toc FROM body""")
def toc(spark, sf_dir):
    paged = F.when(F.col("sort_order") % 3 > 0, F.col("sort_order"))
    rows = unit_rows(spark, sf_dir).select(
        F.col("id").alias("doc"), "title", "group_title", "sort_order", paged.alias("start_page"), (paged + 2).alias("end_page")
    )
    titles = view(spark, sf_dir, "markdown").select(
        F.col("id").alias("doc"), F.concat(F.lit("Doc "), F.col("id").cast("string")).alias("doc_title"), (F.col("id") % 40).alias("page_count")
    )
    return M.table_of_contents(rows, titles)


@query("d18_repack", rf"""{MD}, {UNITS}, {SECTION_ROWS},
    flagged AS (SELECT *, lag(group_title) OVER (PARTITION BY doc ORDER BY sort_order) IS DISTINCT FROM group_title AS changed FROM rows_in)
    SELECT doc AS parent, string_agg(concat_ws({NL2}, CASE WHEN changed THEN concat('## ', group_title) END, nullif({strip_sql('text')}, '')), {NL2} ORDER BY sort_order)
      FILTER (changed OR {strip_sql('text')} <> '') AS body FROM flagged GROUP BY doc""")
def repacked(spark, sf_dir):
    wrapped = F.concat(F.lit("# "), "title", F.lit("\n\n## "), "group_title", F.lit("\n\n"), "text")
    rows = unit_rows(spark, sf_dir).select(
        F.col("id").alias("parent"), F.col("sort_order").alias("id"), "sort_order", "group_title", wrapped.alias("markdown")
    )
    return M.repack(rows)


SELECTED = "CASE id % 3 WHEN 0 THEN substr(body, 40, 60) WHEN 1 THEN 'not in there' ELSE substr(body, 200, 90) END"


@query("d19_reading_context", rf"""{MD},
    picked AS (SELECT id, body, {SELECTED} AS sel FROM markdown),
    cut AS (SELECT id, body, sel, {strip_sql(spaced_sql('sel'))} AS probe,
      list_filter(list_transform(string_split_regex(body, '\n{WS}*\n'), lambda b: {strip_sql('b')}), lambda b: b <> '') AS bs FROM picked),
    hit AS (SELECT *, coalesce(list_position(list_transform(bs, lambda b: probe <> '' AND contains({spaced_sql('b')}, probe)), true), 0) AS pos FROM cut)
    SELECT id, sel AS selection, CASE WHEN pos = 0 THEN sel ELSE array_to_string(bs[greatest(1, pos - 1):pos + 1], {NL2}) END AS paragraph, body AS document FROM hit""")
def reading_context(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").withColumn("sel", F.expr(SELECTED))
    return docs.select(
        "id", F.col("sel").alias("selection"), M.paragraph_context(F.col("body"), F.col("sel")).alias("paragraph"),
        F.col("body").alias("document"),
    )


CUT_SQL = r"string_split(regexp_replace(body, '(?m)^(#{1,4}@+.)', chr(1) || '\1', 'g'), chr(1))".replace("@", WS)
LEVEL_SQL = r"len(regexp_extract(p, '^(#{1,4})@+.', 1))".replace("@", WS)


@query("d19_section_context", f"""{MD}, picked AS (SELECT id, body, {SELECTED} AS sel FROM markdown),
    cut AS (SELECT id, body, sel, CASE WHEN sel = '' THEN 1 ELSE strpos(body, sel) END AS loc, {CUT_SQL} AS ps FROM picked),
    pieces AS (SELECT id, loc, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM cut),
    heads AS (SELECT id, loc, {LEVEL_SQL} AS lvl, 1 + coalesce(sum(len(p)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM pieces),
    own AS (SELECT id, max(st) AS st FROM heads WHERE lvl > 0 AND st <= loc GROUP BY id),
    levelled AS (SELECT o.id, o.st, h.lvl FROM own o JOIN heads h ON h.id = o.id AND h.st = o.st AND h.lvl > 0),
    ends AS (SELECT o.id, o.st, min(h.st) AS en FROM levelled o LEFT JOIN heads h ON h.id = o.id AND h.lvl > 0 AND h.st > o.st AND h.lvl <= o.lvl GROUP BY ALL)
    SELECT id, CASE WHEN loc = 0 THEN sel WHEN e.st IS NULL THEN body
      ELSE substr(body, CAST(e.st AS BIGINT), CAST(coalesce(en, len(body) + 1) - e.st AS BIGINT)) END AS section FROM cut LEFT JOIN ends e USING (id)""")
def section_context(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").withColumn("sel", F.expr(SELECTED))
    return docs.select("id", M.section_context(F.col("body"), F.col("sel")).alias("section"))


SPANS = ("SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id % 300 END AS anchor_start, "
         "CASE WHEN doc_id % 7 = 0 THEN 5 ELSE doc_id % 300 + doc_id % 50 END AS anchor_end FROM documents")


@query("d24_span_context", f"""WITH {view_sql('docs')}, spans AS ({SPANS}),
    cut AS (SELECT id, anchor_start AS s, anchor_end AS e, body, substr(body, anchor_start + 1, anchor_end - anchor_start) AS t FROM docs JOIN spans USING (id)),
    judged AS (SELECT *, s >= 0 AND e > s AND {strip_sql('t')} <> '' AS ok FROM cut)
    SELECT id, s AS anchor_start, e AS anchor_end, CAST(ok AS BIGINT) AS valid, CASE WHEN ok THEN {strip_sql('t')} END AS selected_text,
      CASE WHEN ok THEN substr(body, greatest(0, s - 120) + 1, s - greatest(0, s - 120)) END AS prefix, CASE WHEN ok THEN substr(body, e + 1, 120) END AS suffix FROM judged""")
def spans(spark, sf_dir):
    ranges = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id % 300 END AS anchor_start",
        "CASE WHEN doc_id % 7 = 0 THEN 5 ELSE doc_id % 300 + doc_id % 50 END AS anchor_end",
    ).selectExpr("id", "int(anchor_start) AS anchor_start", "int(anchor_end) AS anchor_end")
    return M.span_context(view(spark, sf_dir, "docs").select("id", "body"), ranges)


OUTLINE_ITEMS = r"""rows_of AS (SELECT id, unnest(ls) AS l, unnest(range(len(ls))) AS n FROM (SELECT id, string_split_regex(body, '\r?\n') AS ls FROM markdown)),
    shaped AS (SELECT id, n, CASE WHEN regexp_matches(l, '^#{1,6}\s+.+') THEN len(regexp_extract(l, '^(#{1,6})\s+', 1)) - 1
        WHEN regexp_matches(l, '^\s*[-*+]\s+.+') THEN len(regexp_extract(l, '^(\s*)[-*+]\s+', 1)) // 2 + 1 END AS depth,
      replace(CASE WHEN regexp_matches(l, '^#{1,6}\s+.+') THEN regexp_extract(l, '^#{1,6}\s+(.+)', 1) ELSE regexp_extract(l, '^\s*[-*+]\s+(.+)', 1) END, '**', '') AS label FROM rows_of),
    items AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS no, depth, label FROM shaped WHERE depth IS NOT NULL),
    walk AS (SELECT id, no, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS level, label, [no] AS stack FROM items WHERE no = 0
      UNION ALL SELECT i.id, i.no, CASE WHEN depth > 0 THEN stack[least(len(stack), depth)] END, least(len(stack), depth), i.label,
        list_append(stack[1:least(len(stack), depth)], i.no) FROM walk w JOIN items i ON i.id = w.id AND i.no = w.no + 1)"""


@query("d25_outline_tree", f"{MD.replace('WITH', 'WITH RECURSIVE', 1)}, {OUTLINE_ITEMS} SELECT id, no, parent, level, label FROM walk")
def tree(spark, sf_dir):
    return M.outline_tree(view(spark, sf_dir, "markdown").select("id", "body"))


REPEATS = f"""prose AS (SELECT id, {block_key_sql('b')} AS k FROM (SELECT id, unnest(string_split_regex(body, '\\n{{2,}}')) AS b FROM markdown) WHERE NOT {opens_sql('b', ('#', '<!--', '```', '|'))}),
    repeats AS (SELECT id, count(*) - count(DISTINCT k) AS n FROM prose WHERE len(k) >= 30 GROUP BY id)"""
ISSUES = r"CAST(NOT contains(body, '<!-- page:') AS BIGINT) + CAST(contains(body, '\(') OR contains(body, '\[') AS BIGINT)"


@query("a6_document_quality_report", f"""{MD}, {REPEATS} SELECT id, len(body) AS characters, len(regexp_extract_all(body, '(?m)^##{WS}+(.+?){WS}*$')) AS chapter_count,
    coalesce(n, 0) AS duplicate_blocks, {ISSUES} AS issue_count FROM markdown LEFT JOIN repeats USING (id)""")
def quality_report(spark, sf_dir):
    return quality_rows(view(spark, sf_dir, "markdown"))


def quality_rows(docs):
    body = F.col("body")
    issue_count = (~body.contains("<!-- page:")).cast("bigint") + body.rlike(r"\\\(|\\\[").cast("bigint")
    return docs.select(
        "id", F.length("body").alias("characters"), F.size(M.found(body, M.LEVEL2, 1)).alias("chapter_count"),
        M.repeated_block_count(body).alias("duplicate_blocks"), issue_count.alias("issue_count"),
    )


@query("a9_readability_metrics", rf"""{MD}, done AS (SELECT id, body, {strip_sql("regexp_replace(body, '(?m)^[ \\t]*>+[ \\t]?', '', 'g')")} AS after FROM markdown)
    SELECT owner, count(*) AS documents, count(*) FILTER (after <> {strip_sql('done.body')}) AS changed,
      CAST(sum(len(regexp_extract_all(done.body, '(?m)^\s{{0,3}}>'))) AS BIGINT) AS quotes_before, CAST(sum(len(regexp_extract_all(after, '(?m)^\s{{0,3}}>'))) AS BIGINT) AS quotes_after,
      CAST(sum(len(string_split(done.body, 'asset://')) - 1) AS BIGINT) AS images_before, CAST(sum(len(string_split(after, 'asset://')) - 1) AS BIGINT) AS images_after
    FROM done JOIN markdown USING (id) GROUP BY owner""")
def readability(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").withColumn("after", X.strip(X.unquoted("body")))
    before, after = M.readability_counts(F.col("body")), M.readability_counts(F.col("after"))
    return docs.groupBy("owner").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("after") != X.strip("body")).alias("changed"),
        F.sum(before[0]).alias("quotes_before"), F.sum(after[0]).alias("quotes_after"),
        F.sum(before[1]).alias("images_before"), F.sum(after[1]).alias("images_after"),
    )


@query("c1_normalize_key", f"{MD} SELECT id, {key_sql('body')} AS k FROM markdown")
def normalized_key(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("id", X.bare_key("body").alias("k"))


@query("c2_normalize_space", f"{MD} SELECT id, {folded_sql('body')} AS spaced, {compact_sql('body')} AS compacted FROM markdown")
def normalized_space(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("id", X.folded_space("body").alias("spaced"), X.compact("body").alias("compacted"))


@query("c5_dollar_math", rf"{MD} SELECT id, regexp_replace(regexp_replace(body, '(?s)\\\((.+?)\\\)', '$\1$', 'g'), '(?s)\\\[(.+?)\\\]', '$$\1$$', 'g') AS body FROM markdown")
def math(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("id", X.dollar_math("body").alias("body"))


ASCII_WORDS = r"regexp_replace(regexp_replace(body, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


@query("c7_protected_tokens", rf"""{MD} SELECT id, array_to_string(regexp_extract_all(body, '(?s)\$\$.*?\$\$|\$.*?\$'), '|') AS formulas,
    array_to_string(regexp_extract_all(body, '\[[0-9,\-\s]+\]|\([^)]*\b(?:19|20)\d{{2}}[^)]*\)'), '|') AS citations,
    array_to_string(list_sort(list_distinct(regexp_extract_all({ASCII_WORDS}, '\b[A-Z][A-Za-z0-9+\-]{{1,30}}\b'))), '|') AS terms FROM markdown""")
def tokens(spark, sf_dir):
    parts = M.protected_tokens(F.col("body"))
    docs = view(spark, sf_dir, "markdown").select("id", *parts)
    return docs.select("id", *[F.array_join(c, "|").alias(c) for c in ("formulas", "citations", "terms")])


@query("c17_clean_heading", rf"""{MD}, heads AS (SELECT id, unnest(hs) AS raw, unnest(range(len(hs))) AS pos FROM (SELECT id, regexp_extract_all(body, '(?m)^#+{WS}(.*)$', 1) AS hs FROM markdown))
    SELECT id, pos, {heading_sql('raw')} AS heading FROM heads""")
def headings(spark, sf_dir):
    heads = view(spark, sf_dir, "markdown").select("id", F.posexplode(M.found(F.col("body"), rf"(?md)^#+{X.BLANK}(.*)$", 1)).alias("pos", "raw"))
    return heads.select("id", "pos", X.clean_heading("raw").alias("heading"))
