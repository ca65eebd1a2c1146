"""Ingestion, web pages and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.operators import figures as G
from tessaly.operators.chunking import split_text
from tessaly.plans.markdown import ISSUES, MD, REPEATS, quality_rows
from tessaly.plans.registry import query
from tessaly.plans.retrieval import chunks_sql
from tessaly.plans.views import WS, any_sql, lines_sql, spaced_sql, strip_sql, view, view_sql
from tessaly.session import table
from tessaly.sources import corpus, sinks, web

PATH = "concat('/in/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.Markdown' END)"


@query("s1_read_text_corpus", f"""WITH files AS (SELECT {PATH} AS path, text FROM documents) SELECT path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text, NULL AS error FROM files WHERE NOT ends_with(path, '.pdf')
    UNION ALL SELECT path, NULL, 'Unsupported file type: .pdf' FROM files WHERE ends_with(path, '.pdf')""")
def text_corpus(spark, sf_dir):
    # Every file gets one byte which is not UTF-8; it has to vanish.
    content = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    files = table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), content.alias("content"))
    texts, rejects = corpus.decode_files(files)
    return texts.unionByName(rejects, allowMissingColumns=True)


CATALOGUE = ("concat('{\"schema_version\": 2, \"canteen_dishes\": [{\"id\": \"c', CAST(p_partkey AS STRING), '\", \"food_name\": \"', p_name, '\", \"price\": ', CAST(p_size AS STRING), '.5}], \"restaurants\": [{\"name\": \"', p_brand, "
             "'\"}, {\"name\": \"x\"}]', CASE WHEN p_partkey % 50 = 7 THEN '' ELSE '}' END)")


@query("s2_read_catalogue", """SELECT p_partkey, 'canteen_dishes' AS collection, concat('c', p_partkey) AS id, p_name AS label, p_size + 0.5::DOUBLE AS price, NULL AS error FROM part WHERE p_partkey % 50 <> 7
    UNION ALL SELECT p_partkey, 'restaurants', NULL, p_brand, NULL, NULL FROM part WHERE p_partkey % 50 <> 7 UNION ALL SELECT p_partkey, 'restaurants', NULL, 'x', NULL, NULL FROM part WHERE p_partkey % 50 <> 7
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'corrupt catalogue' FROM part WHERE p_partkey % 50 = 7""")
def catalogues(spark, sf_dir):
    records, errors = corpus.parse_catalogue(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{CATALOGUE} AS value"))
    rows = records.select("p_partkey", "collection", "id", F.coalesce("food_name", "name").alias("label"), "price")
    return rows.unionByName(errors, allowMissingColumns=True)


@query("s3_write_replace", f"""WITH {view_sql('docs')}, old AS {chunks_sql('docs', 'id', 'body', V.INDEX_CHUNK, V.INDEX_OVERLAP)}, edited AS (SELECT * FROM docs WHERE id % 3 = 0), new AS {chunks_sql('edited', 'id', 'body', 700, 100)}
    SELECT id, chunk_index, content FROM old WHERE id % 3 <> 0 UNION ALL SELECT id, chunk_index, content FROM new""")
def replaced(spark, sf_dir):
    docs = view(spark, sf_dir, "docs").select("id", "body")
    edited = docs.filter("id % 3 = 0")
    return sinks.write_replace(split_text(docs, size=V.INDEX_CHUNK, overlap=V.INDEX_OVERLAP), split_text(edited), edited, ["id"])


FILE_SQL = "SELECT doc_id, concat('Course ', doc_id % 700, '.v1.TXT') AS name, text AS content FROM documents"
STORED = "concat('Course ', doc_id % 700, '.v1_', substr(sha256(content), 1, 12), '.txt')"


@query("s4_content_addressed_ingest", f"""WITH files AS ({FILE_SQL}), named AS (SELECT doc_id, name, {STORED} AS stored_name FROM files)
    SELECT stored_name, min(name) AS name FROM named WHERE stored_name NOT IN (SELECT stored_name FROM named WHERE doc_id % 2 = 0) GROUP BY stored_name""")
def ingested(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('Course ', doc_id % 700, '.v1.TXT') AS name", "text AS content")
    return sinks.ingest_missing(files, sinks.content_addressed(files.filter("doc_id % 2 = 0")))


@query("s5_skip_or_resume", f"""WITH {view_sql('library')}, files AS (SELECT DISTINCT concat('Title ', doc_id % 120) AS title FROM documents), shared AS (SELECT * FROM library WHERE is_global AND library_scope = 'course')
    SELECT title, max(id) AS resume_id, CASE WHEN max(id) IS NULL THEN 'create' ELSE 'resume' END AS action FROM files LEFT JOIN shared USING (title)
    WHERE title NOT IN (SELECT title FROM shared WHERE status = 'ready') GROUP BY title""")
def resumed(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr("concat('Title ', doc_id % 120) AS title").distinct()
    return sinks.skip_or_resume(files, view(spark, sf_dir, "library"))


@query("s6_export_quality_report", f"""{MD}, {REPEATS} SELECT id, concat('{{"id":', id, ',"characters":', len(body), ',"chapter_count":', len(regexp_extract_all(body, '(?m)^##{WS}+(.+?){WS}*$')),
    ',"duplicate_blocks":', coalesce(n, 0), ',"issue_count":', {ISSUES}, '}}') AS report FROM markdown LEFT JOIN repeats USING (id)""")
def report(spark, sf_dir):
    rows = quality_rows(view(spark, sf_dir, "markdown"))
    return rows.select("id", F.to_json(F.struct("id", "characters", "chapter_count", "duplicate_blocks", "issue_count")).alias("report"))


@query("j13_part_cache_miss", f"""WITH {view_sql('docs')}, parts AS (SELECT id, chunk_index, concat(chunk_index + 1, ':', substr(sha1(content), 1, 16)) AS part_key FROM {chunks_sql('docs', 'id', 'body', V.PART_LIMIT, 0)}),
    cache AS (SELECT part_key, max(CASE WHEN id % 6 = 0 THEN '  ' ELSE 'out' END) AS output FROM parts WHERE id % 3 = 0 GROUP BY part_key)
    SELECT id, chunk_index, parts.part_key, CASE WHEN trim(output) <> '' THEN 'hit' ELSE 'miss' END AS state FROM parts LEFT JOIN cache USING (part_key)""")
def cache_misses(spark, sf_dir):
    parts = split_text(view(spark, sf_dir, "docs").select("id", "body"), size=V.PART_LIMIT, overlap=0)
    keyed = parts.select("id", "chunk_index", sinks.part_key(F.col("chunk_index") + 1, F.col("content")).alias("part_key"))
    cache = keyed.filter("id % 3 = 0").groupBy("part_key").agg(F.max(F.when(F.col("id") % 6 == 0, "  ").otherwise("out")).alias("output"))
    hits, misses = sinks.part_cache_miss(keyed, cache)
    return hits.drop("output").withColumn("state", F.lit("hit")).unionByName(misses.withColumn("state", F.lit("miss")))


ITEM = ("concat('<li class=\"b_algo\"><h2 x><a q href=\"', url, '&amp;z=1\">', regexp_extract(html, '<title>(.*?)</title>', 1), ' <b>bold</b></a></h2><p class=\"s\">', "
        "CAST(page_id AS STRING), '  &lt;i&gt;of&lt;/i&gt;  text</p></li><li class=\"b_algo\">no link</li>')")
RESULTS = f"concat('<ol>', {ITEM}, {ITEM}, {ITEM}, '</ol>')"


@query("c8_result_items", rf"""WITH parsed AS (SELECT page_id, concat(url, '&z=1') AS url, {strip_sql(spaced_sql("regexp_replace(replace(concat(regexp_extract(html, '<title>(.*?)</title>', 1), ' bold'), '&amp;', '&'), '<[^>]+>', '', 'g')"))} AS title,
      concat(page_id, ' of text') AS snippet FROM pages) SELECT page_id, position, title, url, snippet FROM parsed CROSS JOIN (VALUES (1), (2)) p(position)""")
def results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", f"{RESULTS} AS html")
    return web.result_items(pages, "b_algo", 2)


OUTLINED = "CASE WHEN page_id % 10 = 0 THEN html ELSE replace(replace(html, '<h1>', '<h1 id=\"top\">'), '<p><b>', '<h2 id=\"lead\">Lead <i>in</i> &amp; out</h2><p><b>') END"


@query("c9_html_outline", rf"""WITH src AS (SELECT page_id, {OUTLINED} AS h FROM pages), hs AS (SELECT page_id, unnest(a) AS id, unnest(b) AS raw, unnest(c) AS level, unnest(range(len(a))) AS position FROM (
      SELECT page_id, regexp_extract_all(h, '(?s)<h[1-3] id="([^"]+)">(.*?)</h[1-3]>', 1) AS a, regexp_extract_all(h, '(?s)<h[1-3] id="([^"]+)">(.*?)</h[1-3]>', 2) AS b, regexp_extract_all(h, '(?s)<h([1-3]) id="([^"]+)">(.*?)</h[1-3]>', 1) AS c FROM src))
    SELECT page_id, position, CAST(level AS BIGINT) AS level, id AS section_id, replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '&amp;', '&') AS label FROM hs
    UNION ALL SELECT page_id, 0, 1, 'document-start', '00_原文' FROM src WHERE page_id NOT IN (SELECT page_id FROM hs)""")
def outlines(spark, sf_dir):
    return web.html_outline(table(spark, sf_dir, "pages").selectExpr("page_id", f"{OUTLINED} AS html"))


WRAPPED = "CASE event_id % 3 WHEN 0 THEN concat('Answer: ```json ', props, ' ``` done') WHEN 1 THEN concat('So ', props, ' it is') ELSE props END"


@query("c10_extract_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", corpus.extract_json(F.expr(WRAPPED)).alias("j"))
    return rows.select("event_id", F.from_json("j", "k bigint")["k"].alias("k"))


FIGURES = ("p_partkey % 40 AS doc, CAST(floor(p_partkey / 400) AS BIGINT) AS page_no, p_partkey AS ord, p_size AS xref, p_size * 9 AS width, p_size % 7 * 60 + 50 AS height, p_partkey % 11 / 10.0 AS coverage")


@query("w8_figure_filter", f"""WITH figures AS (SELECT {FIGURES} FROM part) SELECT doc, xref, page_no, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc, xref ORDER BY page_no, ord) AS n FROM (
      SELECT *, count(*) OVER (PARTITION BY doc, xref) AS uses FROM figures) WHERE coverage < 0.85 AND width * height >= 18000 AND least(width, height) >= 70) WHERE n = 1 AND uses < 3""")
def kept_figures(spark, sf_dir):
    return G.figure_filter(table(spark, sf_dir, "part").selectExpr(*FIGURES.split(", ")))


LAYOUT = ("CAST(floor(p_partkey / 12) AS BIGINT) AS page_no, p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 20 WHEN p_size % 2 = 0 THEN 30 ELSE 320 END AS x0, p_size * 13 % 97 AS y0, "
          "CASE WHEN p_partkey % 5 = 0 THEN 560 WHEN p_size % 2 = 0 THEN 280 ELSE 570 END AS x1")


@query("d22_order_layout_blocks", f"""WITH blocks AS (SELECT {LAYOUT} FROM part), m AS (SELECT *, (x1 - x0) < 600 * 0.72 AS narrow, (x0 + x1) / 2 AS mid FROM blocks),
    c AS (SELECT *, count(*) FILTER (narrow AND mid < 288) OVER w >= 2 AND count(*) FILTER (narrow AND mid > 312) OVER w >= 2 AS two FROM m WINDOW w AS (PARTITION BY page_no)),
    b AS (SELECT *, (SELECT count(*) FROM c o WHERE o.page_no = c.page_no AND NOT o.narrow AND (CASE WHEN c.narrow THEN o.y0 <= c.y0 ELSE o.y0 < c.y0 OR (o.y0 = c.y0 AND o.ord < c.ord) END)) AS band FROM c)
    SELECT page_no, ord, CAST(two AS BIGINT) AS two_columns, row_number() OVER (PARTITION BY page_no ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN NOT two THEN 0 WHEN NOT narrow THEN 2 WHEN mid < 300 THEN 0 ELSE 1 END,
      y0, CASE WHEN two THEN 0 ELSE x0 END, ord) AS position FROM b""")
def layout(spark, sf_dir):
    blocks = table(spark, sf_dir, "part").selectExpr("0 AS doc", "concat('t', p_name) AS text", "0 AS y1", "600 AS page_width", *[c.strip() for c in _columns(LAYOUT)])
    return G.order_layout_blocks(blocks).select("page_no", "ord", "two_columns", "position")


def _columns(text: str) -> list[str]:
    """Top-level comma separated select items."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(text[start:i])
            start = i + 1
    return [*items, text[start:]]


@query("j8_bind_figures")
def bound_figures(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", "body")
    assets = docs.select("id", F.explode(F.sequence(F.lit(0), F.col("id").cast("int") % 12)).alias("n")).select(
        "id", (F.col("n") % 4 + 2).alias("page_no"), F.col("n").alias("ordinal"),
        F.concat(F.lit("asset://page-00"), (F.col("n") % 4 + 2).cast("string"), F.lit("-figure-"), F.col("n").cast("string"), F.lit(".png")).alias("asset"),
    )
    return G.bind_figures(docs, assets)


# Images inside lines, open marks, pages without anchor: the pages' own images all stand on lines of their own.
SCAN_FORMS = ("replace(replace(replace(replace(body, 'ipsum', concat('![m](asset://page-007-figure-2.png)', chr(10))), 'and [图', concat('and ![](asset://page-003-figure-4.png) [图')), '![fig]', '[待核对] ![fig]'), '- first', '![k](asset://page-004-figure-1.png)')")
SCAN_IMAGE = r"!\[[^\]]*\]\(asset://page-0*[37]-figure-\d+\.png\)"


def reference_sql(image: str) -> str:
    alt, page, source = (rf"regexp_extract({image}, '!\[([^\]]*)\]\((asset://page-0*(\d+)-figure-\d+\.png)\)', {i})" for i in (1, 3, 2))
    label = f"CASE WHEN {strip_sql(alt)} = '' THEN concat('第 ', {page}, ' 页原始内容') ELSE {strip_sql(alt)} END"
    return (f"concat('<details data-source-page-scan=\"true\">', chr(10), '<summary>原页核对：', {label}, '</summary>', chr(10), chr(10), '![', {label}, '](', {source}, ')', chr(10), chr(10), '</details>')")


# Lines are rows here: a line that is an image alone goes, images in other lines become notes.
SCANS_SQL = f"""WITH {view_sql('markdown')}, bodies AS (SELECT id, regexp_replace({SCAN_FORMS}, '(?m)^[ \\t]*>+[ \\t]?', '', 'g') AS body FROM markdown),
    numbered AS (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS n FROM bodies WHERE id % 2 = 0),
    anchored AS (SELECT *, CAST(regexp_extract(line, '^<!-- page:(\\d+) -->', 1) AS VARCHAR) AS anchor FROM numbered),
    paged AS (SELECT *, sum(CASE WHEN anchor <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS part FROM anchored),
    judged AS (SELECT *, {strip_sql('line')} AS core, regexp_extract_all(line, '{SCAN_IMAGE}') AS images FROM paged),
    marked AS (SELECT *, len(images) > 0 AND regexp_full_match(core, '{SCAN_IMAGE}') AS alone FROM judged),
    parts AS (SELECT id, part, max(anchor) IN ('3', '7') AND sum(len(images)) > 0 AS scan, bool_or(contains(line, '[待核对]')) OR bool_or(len(images) > 0 AND NOT alone) AS needed,
        (list(images ORDER BY n) FILTER (len(images) > 0))[1][1] AS first_image, list(images ORDER BY n) FILTER (len(images) > 0 AND NOT alone) AS inline_images,
        string_agg(CASE WHEN alone THEN '' ELSE regexp_replace(line, '{SCAN_IMAGE}', '（矩阵或公式见下方原页核对）', 'g') END, chr(10) ORDER BY n) AS below,
        string_agg(CASE WHEN alone THEN '' ELSE regexp_replace(line, '{SCAN_IMAGE}', '（矩阵或公式见文末原页核对）', 'g') END, chr(10) ORDER BY n) AS at_end FROM marked GROUP BY id, part),
    pieces AS (SELECT id, part, NOT scan AS loose, inline_images, CASE WHEN scan THEN concat(regexp_replace(regexp_replace(below, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', ''), CASE WHEN needed THEN concat(chr(10), chr(10), {reference_sql('first_image')}) ELSE '' END, chr(10))
        ELSE concat(at_end, chr(10)) END AS piece FROM parts),
    joined AS (SELECT id, regexp_replace(string_agg(piece, '' ORDER BY part), '\\s+$', '') AS body, flatten(list(inline_images ORDER BY part) FILTER (loose AND inline_images IS NOT NULL)) AS moved FROM pieces GROUP BY id),
    ended AS (SELECT id, body, string_agg({reference_sql('image')}, chr(10) || chr(10) ORDER BY place) AS notes FROM (
        SELECT id, body, unnest(CASE WHEN len(moved) > 0 THEN flatten(moved) ELSE [NULL] END) AS image, unnest(range(greatest(len(CASE WHEN len(moved) > 0 THEN flatten(moved) ELSE [NULL] END), 1))) AS place FROM joined) GROUP BY id, body)
    SELECT id, {strip_sql("body")} AS body FROM bodies WHERE id % 2 <> 0
    UNION ALL SELECT id, {strip_sql("regexp_replace(CASE WHEN notes IS NULL OR NOT contains(notes, 'asset://page-0') THEN body ELSE concat(body, chr(10), chr(10), notes) END, '\\n{3,}', chr(10) || chr(10), 'g')")} FROM ended"""


@query("d20_scan_page_cleanup", SCANS_SQL)
def tidy_scans(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", F.expr(SCAN_FORMS).alias("body"))
    return docs.select("id", G.scan_page_cleanup(F.col("body"), F.when(F.col("id") % 2 == 0, F.array(F.lit(3), F.lit(7)))).alias("body"))


def split_lines_sql(source: str) -> str:
    """(id, n, line, core) of the lines of ``source`` (id, body); a line break at the end opens no further line."""
    return (f"(SELECT id, n, line, {strip_sql('line')} AS core FROM (SELECT id, unnest({lines_sql('body')}) AS line, unnest(range(len({lines_sql('body')}))) AS n, "
            f"len({lines_sql('body')}) AS size FROM {source}) WHERE n < size - 1 OR line <> '')")


def wrapped_sql(inserted: str) -> str:
    """CTEs up to ``wrapped`` (id, body): the bodies with the inserted lines, bare formulas wrapped."""
    display = lambda formula: f"concat('$$', chr(10), {formula}, chr(10), '$$')"
    odd = lambda test: f"coalesce(sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER above, 0) % 2 = 1"
    return f"""WITH {view_sql('markdown')}, given AS (SELECT id, replace(body, concat(chr(10), chr(10), 'Th'), {inserted}) AS body FROM markdown),
    plain AS (SELECT id, replace(replace(replace(replace(body, '\\[', '$$'), '\\]', '$$'), '\\(', '$'), '\\)', '$') AS body FROM given),
    sided AS (SELECT *, {odd("starts_with(core, '```')")} OR {odd("core = '$$'")} AS inside FROM {split_lines_sql('plain')} WINDOW above AS (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    bare AS (SELECT *, NOT inside AND NOT contains(core, '$') AND NOT starts_with(core, '```') AND {any_sql('core', G.LATEX_HINTS)} AS bare, starts_with(core, '[') AND ends_with(core, ']') AS bracketed FROM sided),
    wrapped AS (SELECT id, string_agg(CASE WHEN bare AND bracketed THEN {display(strip_sql('substr(core, 2, len(core) - 2)'))} WHEN bare AND NOT regexp_matches(core, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN {display('core')} ELSE line END, chr(10) ORDER BY n) AS body FROM bare GROUP BY id)"""


FORMULA = "concat(chr(10), chr(10), '\\frac{a}{b}', chr(10), "


@query("c6_wrap_bare_math", wrapped_sql(FORMULA + "'  | a | b |', chr(10), 'Th')") + f""", rows AS (SELECT *, starts_with(core, '|') AND ends_with(core, '|') AS in_table FROM {split_lines_sql('wrapped')}),
    beside AS (SELECT *, lag(core) OVER w AS above, lag(in_table) OVER w AS table_above FROM rows WINDOW w AS (PARTITION BY id ORDER BY n))
    SELECT id, string_agg(concat(CASE WHEN in_table <> table_above AND core <> '' AND above <> '' THEN chr(10) ELSE '' END, CASE WHEN in_table THEN regexp_replace(line, '^{WS}+', '') ELSE line END), chr(10) ORDER BY n) AS body FROM beside GROUP BY id""")
def bare_math(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", F.replace(F.col("body"), F.lit("\n\nTh"), F.lit("\n\n\\frac{a}{b}\n  | a | b |\nTh")).alias("body"))
    return docs.select("id", G.unindent_tables(G.wrap_bare_math(F.col("body"))).alias("body"))


@query("c6_math_blocks", wrapped_sql(FORMULA + "chr(10), 'Th')") + f""", pieces AS (SELECT id, unnest(string_split(body, '$$')) AS piece, unnest(range(len(string_split(body, '$$')))) AS place, len(string_split(body, '$$')) AS size FROM wrapped),
    closed AS (SELECT id, CASE WHEN size % 2 = 0 AND place = size - 1 THEN place - 1 ELSE place END AS position, string_agg(piece, '$$' ORDER BY place) AS piece FROM pieces GROUP BY ALL)
    SELECT id, position, CASE WHEN position % 2 = 1 THEN 'math' ELSE 'markdown' END AS kind, CASE WHEN position % 2 = 1 THEN {strip_sql('piece')} ELSE piece END AS text FROM closed WHERE piece <> ''""")
def blocks(spark, sf_dir):
    docs = view(spark, sf_dir, "markdown").select("id", F.replace(F.col("body"), F.lit("\n\nTh"), F.lit("\n\n\\frac{a}{b}\n\nTh")).alias("body"))
    return G.math_blocks(docs)
