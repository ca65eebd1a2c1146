"""Queries over paged documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.operators import pages as P
from tessaly.plans.registry import query
from tessaly.plans.views import any_sql, key_sql, lines_sql, present_sql, spaced_sql, strip_sql, view, view_sql
from tessaly.session import table


def squeezed(words):
    return [w.replace(" ", "") for w in words]


#: Limits of a role by position, for books whose front matter is short.
FRONT = {"front_pages": 32, "title_pages": 3}


def roles_sql(source: str, front_pages: int | None = None, title_pages: int | None = None) -> str:
    """roled: the page table with page_count and role."""
    late = "false" if front_pages is None else f"page_no > least(page_count, {front_pages})"
    title = "false" if title_pages is None else f"page_no <= {title_pages}"
    return f"""squeezed AS (SELECT *, count(*) OVER (PARTITION BY doc) AS page_count, {strip_sql(spaced_sql('text'))} AS spaced FROM {source}),
    keyed AS (SELECT *, {key_sql('lower(spaced)')} AS bare FROM squeezed),
    roled AS (SELECT doc, page_no, text, page_count, CASE
      WHEN {any_sql('bare', squeezed(V.CLOSING_TERMS))} THEN 'skip'
      WHEN {late} THEN 'content'
      WHEN {any_sql('bare', squeezed(V.OUTLINE_TERMS))} THEN 'outline'
      WHEN {any_sql('bare', squeezed(V.FRONT_MATTER_TERMS))} AND (len(bare) <= 2100 OR {any_sql('spaced', V.METADATA_MARKERS)}) THEN 'skip'
      WHEN {title} AND len(bare) <= 550 AND NOT regexp_matches(spaced, '{V.TEACHING_SIGNAL}') THEN 'skip'
      ELSE 'content' END AS role FROM keyed)"""


BOOK = f"WITH {view_sql('book_pages')}, {roles_sql('book_pages')}"


def book(spark, sf_dir):
    return P.with_roles(view(spark, sf_dir, "book_pages"))


@query("w1_strip_page_boilerplate", f"""WITH {view_sql('doc_pages')},
    sizes AS (SELECT doc, count(*) AS n FROM doc_pages GROUP BY doc),
    each AS (SELECT doc, page_no, unnest(ls) AS raw, unnest(range(len(ls))) AS line_no FROM (SELECT doc, page_no, {lines_sql('text')} AS ls FROM doc_pages)),
    keyed AS (SELECT doc, page_no, line_no, line, {key_sql('line')} AS k FROM (SELECT *, {strip_sql('raw')} AS line FROM each) WHERE line <> ''),
    rep AS (SELECT doc, k FROM keyed JOIN sizes USING (doc) WHERE len(line) BETWEEN 3 AND 100 AND k <> '' AND n >= 3
      GROUP BY doc, k, n HAVING count(DISTINCT page_no) >= greatest(3, ceil(n * CAST(0.6 AS DOUBLE)))),
    kept AS (SELECT doc, page_no, line_no, line FROM (
      SELECT k.*, r.k AS hit, row_number() OVER (PARTITION BY k.doc, k.k ORDER BY page_no, line_no) AS nth FROM keyed k LEFT JOIN rep r ON r.doc = k.doc AND r.k = k.k)
      WHERE hit IS NULL OR nth = 1)
    SELECT p.doc, p.page_no, CASE WHEN p.doc IN (SELECT doc FROM rep) THEN coalesce(c.joined, '') ELSE p.text END AS text
    FROM doc_pages p LEFT JOIN (SELECT doc, page_no, string_agg(line, chr(10) ORDER BY line_no) AS joined FROM kept GROUP BY ALL) c
      ON c.doc = p.doc AND c.page_no = p.page_no""")
def boilerplate(spark, sf_dir):
    return P.strip_page_boilerplate(view(spark, sf_dir, "doc_pages"))


@query("d1_page_role", f"WITH {view_sql('book_pages')}, {roles_sql('book_pages', title_pages=FRONT['title_pages'])} SELECT doc, page_no, role FROM roled")
def page_roles(spark, sf_dir):
    """Every rule of a role, on every page: title pages are told too, outlines and front matter wherever they stand."""
    return P.with_roles(view(spark, sf_dir, "book_pages"), title_pages=FRONT["title_pages"]).select("doc", "page_no", "role")


@query("d1_page_role_by_position", f"WITH {view_sql('book_pages')}, {roles_sql('book_pages', **FRONT)} SELECT doc, page_no, role FROM roled")
def page_roles_by_position(spark, sf_dir):
    return P.with_roles(view(spark, sf_dir, "book_pages"), **FRONT).select("doc", "page_no", "role")


@query("a8_page_role_counts", f"""{BOOK} SELECT doc, count(*) FILTER (role = 'content') AS learning, count(*) FILTER (role = 'outline') AS outline,
    count(*) FILTER (role = 'skip') AS skipped FROM roled GROUP BY doc""")
def role_counts(spark, sf_dir):
    return book(spark, sf_dir).groupBy("doc").agg(*[
        F.count_if(F.col("role") == role).alias(name)
        for role, name in (("content", "learning"), ("outline", "outline"), ("skip", "skipped"))
    ])


PROFILE_PAGES = ("book_pages AS (SELECT conv_id AS doc, CAST(turn + 1 AS INT) AS page_no, CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN "
                 "concat('Abstract and Introduction', chr(10), text) ELSE text END AS text FROM conversations)")


@query("d2_document_profile", f"""WITH {PROFILE_PAGES},
    joined AS (SELECT doc, string_agg(text, chr(10) ORDER BY page_no) AS body, count(*) AS page_count FROM book_pages GROUP BY doc),
    flagged AS (SELECT *, CASE doc % 4 WHEN 0 THEN 'Course' WHEN 1 THEN '论文' ELSE 'note' END AS doc_type, {present_sql('lower(body)', V.PAPER_MARKERS)} AS hits FROM joined),
    judged AS (SELECT *, hits >= 2 OR lower(doc_type) IN ('paper', '论文') AS paper FROM flagged)
    SELECT doc, page_count, len(body) AS character_count,
      CASE WHEN paper THEN 'paper' WHEN lower(doc_type) IN ('course', '课程') THEN 'course' ELSE 'other' END AS kind,
      CASE WHEN NOT paper AND page_count <= 10 AND len(body) <= 18000 THEN 'compact_complete' ELSE 'chapter_reconstruction' END AS strategy FROM judged""")
def profile(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc", "CAST(turn + 1 AS INT) AS page_no",
        "CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN concat('Abstract and Introduction', chr(10), text) ELSE text END AS text",
    )
    types = pages.select("doc").distinct().withColumn(
        "doc_type", F.expr("CASE doc % 4 WHEN 0 THEN 'Course' WHEN 1 THEN '论文' ELSE 'note' END")
    )
    return P.document_profile(pages, types)


STARTS = f"""{BOOK},
    each AS (SELECT doc, page_no, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT doc, page_no, {lines_sql('text')} AS ls FROM roled WHERE role = 'content')),
    starts AS (SELECT doc, page_no, arg_min(line, line_no) AS heading FROM (SELECT doc, page_no, line_no, {strip_sql(spaced_sql('raw'))} AS line FROM each)
      WHERE regexp_matches(line, '{V.CHAPTER_LINE}') GROUP BY doc, page_no),
    cleaned AS (SELECT doc, page_no, regexp_replace(heading, '^[ \\-_:：]+|[ \\-_:：]+$', '', 'g') AS heading FROM starts),
    usable AS (SELECT doc, page_no, heading, {key_sql('heading')} AS k, regexp_extract(heading, '{V.CHAPTER_NUMBER}', 1) AS num FROM cleaned
      WHERE NOT {any_sql('lower(heading)', V.ANSWER_KEY_MARKERS)}),
    accepted AS (SELECT doc, page_no, heading FROM (
      SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY page_no) AS nk, row_number() OVER (PARTITION BY doc, num ORDER BY page_no) AS nn FROM usable WHERE k <> '')
      WHERE nk = 1 AND (nn = 1 OR num = ''))"""


@query("d3_chapter_starts", f"{STARTS} SELECT * FROM starts")
def starts(spark, sf_dir):
    return P.chapter_starts(book(spark, sf_dir))


@query("d4_dedupe_chapter_starts", f"{STARTS} SELECT * FROM accepted")
def accepted_starts(spark, sf_dir):
    return P.dedupe_chapter_starts(P.chapter_starts(book(spark, sf_dir)))


@query("w5_chapter_ranges", f"""{STARTS} SELECT doc, heading, page_no AS start_page,
    greatest(page_no, coalesce(lead(page_no) OVER (PARTITION BY doc ORDER BY page_no) - 1, n)) AS end_page
    FROM accepted JOIN (SELECT doc, count(*) AS n FROM book_pages GROUP BY doc) USING (doc)""")
def ranges(spark, sf_dir):
    roled = book(spark, sf_dir)
    counts = roled.groupBy("doc").agg(F.max("page_count").alias("page_count"))
    return P.chapter_ranges(P.dedupe_chapter_starts(P.chapter_starts(roled)), counts)


@query("w6_unique_titles", f"""WITH {view_sql('book_pages')}, chapters AS (SELECT doc, page_no AS start_page, concat('Part ', page_no % 3) AS title FROM book_pages)
    SELECT doc, start_page, CASE WHEN row_number() OVER (PARTITION BY doc, title ORDER BY start_page) > 1 THEN concat(title, '（续）') ELSE title END AS title FROM chapters""")
def titles(spark, sf_dir):
    chapters = view(spark, sf_dir, "book_pages").select(
        "doc", F.col("page_no").alias("start_page"), F.concat(F.lit("Part "), (F.col("page_no") % 3).cast("string")).alias("title")
    )
    return P.unique_titles(chapters)


@query("d5_normalise_chapters", f"""{BOOK},
    counts AS (SELECT doc, count(*) AS n, count(*) FILTER (role = 'content') AS c FROM roled GROUP BY doc),
    learning AS (SELECT doc, page_no FROM roled JOIN counts USING (doc) WHERE role = 'content' OR c = 0),
    plan AS (SELECT doc, page_no AS item, concat('# Part ', page_no % 3, ' ') AS title, page_no - page_no % 2 AS s, page_no + 2 AS e FROM book_pages WHERE doc % 6 <> 5),
    clamped AS (SELECT doc, item, title, greatest(1, least(n, s)) AS lo, greatest(greatest(1, least(n, s)), least(n, e)) AS hi FROM plan JOIN counts USING (doc)),
    placed AS (SELECT p.doc, p.item, trim(ltrim(p.title, '#')) AS title, min(l.page_no) AS start_page, max(l.page_no) AS end_page
      FROM clamped p JOIN learning l ON l.doc = p.doc AND l.page_no BETWEEN p.lo AND p.hi GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc, start_page ORDER BY end_page, item) AS m, max(end_page) OVER (PARTITION BY doc, start_page) AS top FROM placed),
    terms AS (SELECT doc, start_page, string_agg(title, '|' ORDER BY m) AS key_terms FROM (SELECT doc, start_page, title, min(m) AS m FROM numbered WHERE m > 1 GROUP BY ALL) GROUP BY ALL),
    merged AS (SELECT n1.doc, n1.start_page, n1.title, n1.top AS end_page, coalesce(t.key_terms, '') AS key_terms, row_number() OVER (PARTITION BY n1.doc ORDER BY n1.start_page) AS nth
      FROM numbered n1 LEFT JOIN terms t ON t.doc = n1.doc AND t.start_page = n1.start_page WHERE n1.m = 1),
    capped AS (SELECT m.*, c.n FROM merged m JOIN counts c USING (doc) WHERE nth <= greatest(1, n)),
    named AS (SELECT doc, nth, key_terms, CASE WHEN nth = 1 THEN (SELECT min(page_no) FROM learning l WHERE l.doc = capped.doc) ELSE start_page END AS start_page,
        CASE WHEN row_number() OVER (PARTITION BY doc, title ORDER BY nth) > 1 THEN concat(title, '（续）') ELSE title END AS title FROM capped)
    SELECT doc, title, start_page, CASE WHEN following IS NULL THEN (SELECT max(page_no) FROM learning l WHERE l.doc = led.doc) ELSE greatest(start_page, following - 1) END AS end_page, key_terms
      FROM (SELECT *, lead(start_page) OVER (PARTITION BY doc ORDER BY nth) AS following FROM named) led
    UNION ALL SELECT doc, '正文', 1, n, '' FROM counts WHERE doc NOT IN (SELECT doc FROM named)""")
def normalised(spark, sf_dir):
    roled = book(spark, sf_dir)
    plan = view(spark, sf_dir, "book_pages").filter("doc % 6 <> 5").selectExpr(
        "doc", "page_no AS item", "concat('# Part ', page_no % 3, ' ') AS title",
        "page_no - page_no % 2 AS start_page", "page_no + 2 AS end_page", "CAST(array() AS ARRAY<STRING>) AS key_terms",
    )
    return P.normalise_chapters(plan, roled)


@query("d6_fallback_chapters", """WITH counts AS (SELECT source AS doc, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT concat('conv', conv_id), count(*) FROM conversations GROUP BY conv_id),
    stepped AS (SELECT doc, n, CASE WHEN n > 16 THEN 8 ELSE n END AS step FROM counts),
    runs AS (SELECT doc, n, step, unnest(range(1, n + 1, step)) AS s FROM stepped)
    SELECT doc, CASE WHEN s = 1 AND least(n, s + step - 1) = n THEN '正文' ELSE concat('第 ', s, '-', least(n, s + step - 1), ' 页') END AS title,
      s AS start_page, least(n, s + step - 1) AS end_page FROM runs""")
def fallback(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc")).agg(F.count(F.lit(1)).alias("page_count"))
    talks = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc")).agg(
        F.count(F.lit(1)).alias("page_count")
    )
    return P.fallback_chapters(sources.union(talks))


PARTS = f"""{BOOK.replace('WITH', 'WITH RECURSIVE', 1)},
    blocks AS (SELECT doc, page_no, block, len(block) AS raw, len({strip_sql('block')}) AS bare, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS nth
      FROM (SELECT doc, page_no, concat('<!-- page:', page_no, ' -->', chr(10), chr(10), text) AS block FROM roled WHERE role = 'content')),
    packed AS (SELECT doc, nth, 1 AS part_no, bare AS held, {strip_sql('block')} AS text FROM blocks WHERE nth = 1
      UNION ALL SELECT b.doc, b.nth, CASE WHEN p.held + b.raw > {V.PART_LIMIT} THEN p.part_no + 1 ELSE p.part_no END,
        CASE WHEN p.held + b.raw > {V.PART_LIMIT} THEN b.raw ELSE p.held + 2 + b.bare END,
        CASE WHEN p.held + b.raw > {V.PART_LIMIT} THEN b.block ELSE concat(p.text, chr(10), chr(10), {strip_sql('b.block')}) END
      FROM packed p JOIN blocks b ON b.doc = p.doc AND b.nth = p.nth + 1),
    parts AS (SELECT doc, part_no, count(*) AS pages, arg_max(text, nth) AS text FROM packed GROUP BY doc, part_no)"""


@query("d7_pack_parts", f"{PARTS} SELECT doc, part_no, pages, text FROM parts")
def parts(spark, sf_dir):
    return P.pack_parts(book(spark, sf_dir))


@query("d8_retry_budget", f"""{PARTS} SELECT doc, part_no, CASE WHEN len(text) * 4 >= 14000 OR n >= 8 THEN 6 WHEN len(text) * 4 >= 9000 OR n >= 4 THEN 5 ELSE 4 END AS attempts
    FROM parts JOIN (SELECT doc, count(*) AS n FROM parts GROUP BY doc) USING (doc)""")
def budgets(spark, sf_dir):
    packed = P.pack_parts(book(spark, sf_dir)).select("doc", "part_no", (F.length("text") * 4).alias("chars"))
    counts = packed.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return packed.join(counts, "doc").select("doc", "part_no", P.retry_budget(F.col("chars"), F.col("n")).alias("attempts"))


@query("d21_page_join", f"""WITH {view_sql('doc_pages')} SELECT doc, string_agg(concat('[PAGE ', page_no, ']', chr(10), text), chr(10) || chr(10) ORDER BY page_no) AS original_text
    FROM doc_pages GROUP BY doc""")
def joined_pages(spark, sf_dir):
    return P.join_pages(view(spark, sf_dir, "doc_pages"))


SPARSE_TEXT = "CASE WHEN (conv_id + turn) % 3 = 0 THEN 'p  . 12' ELSE text END"
SPARSE_SQL = f"pages_in AS (SELECT conv_id % 40 AS doc, conv_id * 100 + turn AS page_no, {SPARSE_TEXT} AS text FROM conversations)"


@query("d23_sparse_pages", f"""WITH {SPARSE_SQL}, sparse AS (SELECT doc, page_no FROM pages_in WHERE len(replace(text, ' ', '')) < 12)
    SELECT doc, page_no, CASE WHEN count(*) OVER (PARTITION BY doc) > 8 THEN 'bulk' ELSE 'single' END AS route FROM sparse""")
def sparse(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id % 40 AS doc", "conv_id * 100 + turn AS page_no", f"{SPARSE_TEXT} AS text"
    )
    return P.sparse_pages(pages)


# Documents of one source as the pages of one book, so that books are long enough to be sampled.
SOURCE_BOOK = "SELECT {src} AS doc, row_number() OVER (PARTITION BY {src} ORDER BY doc_id) AS page_no, text FROM documents"


SHELVES = "CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END"
LABELLED_SQL = "concat('[PAGE ', page_no, ' | ', CASE role WHEN 'skip' THEN '跳过正文' WHEN 'outline' THEN '仅结构参考' ELSE '知识正文' END, ']', chr(10), "
TRIMMED_SQL = f"regexp_replace({strip_sql('text')}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def shelf_pages(spark, sf_dir):
    from tessaly.operators.segmented import ranked

    docs = table(spark, sf_dir, "documents").select(F.expr(SHELVES).alias("doc"), "doc_id", "text", F.floor(F.col("doc_id") / 1000).alias("block"))
    return ranked(docs, ["doc"], "block", [F.col("doc_id")], "page_no").select("doc", "page_no", "text")


@query("t5_sample_planning_pages", f"""WITH book_pages AS ({SOURCE_BOOK.format(src=SHELVES)}), {roles_sql('book_pages')}
    SELECT doc, count(*) AS shown, string_agg({LABELLED_SQL}{TRIMMED_SQL}), chr(10) || chr(10) ORDER BY page_no) AS planning_text FROM roled GROUP BY doc""")
def planning(spark, sf_dir):
    return P.planning_text(P.sample_planning_pages(P.with_roles(shelf_pages(spark, sf_dir))))


@query("t5_planning_sample", f"""WITH book_pages AS ({SOURCE_BOOK.format(src=SHELVES)}), {roles_sql('book_pages', **FRONT)},
    counts AS (SELECT doc, count(*) AS n, count(*) FILTER (role = 'content') AS learning FROM roled GROUP BY doc),
    content AS (SELECT doc, page_no, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS nth FROM roled WHERE role = 'content'),
    wanted AS (SELECT DISTINCT doc, CAST(round_even(i * (learning - 1) / greatest(1, samples - 1), 0) AS BIGINT) + 1 AS nth FROM (
      SELECT doc, learning, least(34, learning) AS samples, unnest(range(least(34, learning))) AS i FROM counts WHERE n > 80)),
    chosen AS (SELECT doc, page_no FROM content JOIN wanted USING (doc, nth)
      UNION SELECT doc, page_no FROM roled JOIN counts USING (doc) WHERE n > 80 AND role = 'outline' AND page_no <= 36
      UNION SELECT doc, page_no FROM roled JOIN counts USING (doc) WHERE n <= 80),
    budgets AS (SELECT doc, greatest(700, least(2400, {V.PLANNING_LIMIT} // count(*))) AS budget FROM chosen GROUP BY doc),
    excerpts AS (SELECT doc, page_no, concat('[PAGE ', page_no, ' | ', CASE role WHEN 'skip' THEN '跳过正文' WHEN 'outline' THEN '仅结构参考' ELSE '知识正文' END, ']', chr(10),
        substr(regexp_replace({strip_sql('text')}, '\\n{{3,}}', chr(10) || chr(10), 'g'), 1, budget)) AS part FROM roled JOIN chosen USING (doc, page_no) JOIN budgets USING (doc))
    SELECT doc, count(*) AS shown, substr(string_agg(part, chr(10) || chr(10) ORDER BY page_no), 1, {V.PLANNING_LIMIT}) AS planning_text FROM excerpts GROUP BY doc""")
def planning_sample(spark, sf_dir):
    """The sample of bounded size: 34 content pages of documents above 80 pages, and their first outlines."""
    samples = P.sample_planning_pages(
        P.with_roles(shelf_pages(spark, sf_dir), **FRONT), whole_up_to=80, content_samples=34, outline_pages=36, page_chars=(700, 2400), total_chars=V.PLANNING_LIMIT
    )
    return P.planning_text(samples, V.PLANNING_LIMIT)
