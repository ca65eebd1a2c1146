"""Logical tables over the physical ones.

Every mapping is a list of scalar expressions written in the common subset of Spark SQL
and ANSI SQL, so that the very same text feeds the Spark side and the checking side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions.text import BLANK
from tessaly.session import table

def _marked_up(text: str) -> str:
    """Running text as Markdown: lines become blocks, and lines opening with certain letters
    become headings, page anchors, closing lines, quotes, formulas and figures."""
    marks = (
        ("Th", "## Th"), ("On", "### 1.1 On"), ("Er", "### 1.1.2 Er"), ("In", "### 习题 1.1\n\nIn"), ("At", "### At ##"),
        ("An", "<!-- page:2 -->\n\nAn"), ("He", "<!-- page:3 -->\n\nHe"), ("Re", "Thank You\n\nRe"),
        ("En", "<!-- page:7 -->\n\n# Thank You\n\n<!-- page:8 -->\n\nEn"), ("St", "> quoted \\(St\\) and \\[x\n= 1\\] St"),
        ("Nd", "![fig](placeholder_1.png) and [图：流程图] then [figure] Nd"), ("Or", "![scan](asset://page-003-figure-1.png)\n\nOr"),
        ("Ou", "- first\n  - second\n\nOu"), ("Le", "## Le"), ("De", "### 1.2 De"), ("É", "$a+b$ see [12] and (Smith 1999) É"),
    )
    out = f"replace({text}, chr(10), chr(10) || chr(10))"
    for start, mark in marks:
        literal = " || ".join("chr(10)" if piece == "\n" else f"'{piece}'" for piece in re.split("(\n)", mark) if piece)
        out = f"replace({out}, chr(10) || '{start}', chr(10) || {literal})"
    return out


VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "markdown": ("documents", {
        "id": "doc_id",
        "owner": "source",
        "body": "concat('# Doc ', CAST(doc_id AS STRING), chr(10), chr(10), " + _marked_up("text") + ")",
    }),
    # Documents as library rows: a two-level tree, visibility, status.
    "library": ("documents", {
        "id": "doc_id",
        "owner": "source",
        "doc_type": "CASE lang WHEN 'en' THEN 'course' WHEN 'fr' THEN 'paper' ELSE 'other' END",
        "title": "concat('Title ', CAST(doc_id % 97 AS STRING))",
        "library_scope": "CASE doc_id % 8 WHEN 1 THEN 'public' WHEN 2 THEN 'exam' WHEN 3 THEN 'shared' "
                         "WHEN 4 THEN 'course' WHEN 5 THEN 'paper' WHEN 6 THEN 'other' ELSE 'custom' END",
        "is_global": "doc_id % 3 = 0",
        "document_role": "CASE WHEN doc_id % 5 IN (1, 2) THEN 'section' WHEN doc_id % 5 = 0 THEN 'collection' "
                         "ELSE 'standalone' END",
        "parent_id": "CASE WHEN doc_id % 5 IN (1, 2) THEN doc_id - doc_id % 5 END",
        "sort_order": "CASE WHEN doc_id % 5 IN (1, 2) THEN 3 - doc_id % 5 ELSE 0 END",
        "status": "CASE doc_id % 4 WHEN 2 THEN 'processing' WHEN 3 THEN 'error' ELSE 'ready' END",
        "body": "text",
    }),
    "docs": ("documents", {"id": "doc_id", "owner": "source", "doc_type": "lang", "body": "text"}),
    "asked": ("benchmark", {
        "query_id": "item_id",
        "owner": "concat('src', CAST(item_id % 20 AS STRING))",
        "query_text": "text",
    }),
    # Conversations as paged documents: a running header and a footer are added to each page.
    "doc_pages": ("conversations", {
        "doc": "conv_id",
        "page_no": "CAST(turn + 1 AS INT)",
        "text": "concat('Course_Handout ', CAST(conv_id % 7 AS STRING), chr(10), text, chr(10), '- page -', chr(10), '— ', CAST(turn + 1 AS STRING))",
    }),
    # The same pages with title, contents, preface, chapter and closing pages mixed in.
    "book_pages": ("conversations", {
        "doc": "conv_id",
        "page_no": "CAST(turn + 1 AS INT)",
        "text": "CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN concat('ISBN 978-', CAST(conv_id AS STRING), chr(10), text) "
                "WHEN turn = 1 AND conv_id % 4 = 0 THEN concat('Contents', chr(10), text) "
                "WHEN turn = 3 AND conv_id % 5 = 0 THEN concat(text, chr(10), 'Thank You') "
                "WHEN turn % 2 = 0 THEN concat('Chapter ', CAST(turn / 2 + 1 AS INT), '  Part of ', CAST(conv_id % 3 AS STRING), chr(10), text) "
                "ELSE text END",
    }),
    "memory_events": ("conversations", {
        "user_id": "conv_id",
        "seq": "CAST(turn AS INT)",
        "memory_type": "CASE WHEN turn % 3 = 1 THEN 'food_preference' ELSE 'user' END",
        "content": "CASE WHEN turn = 1 THEN concat('饮食偏好：不吃辣，', role) "
                   "WHEN turn = 4 THEN '饮食偏好：喜欢辣' "
                   "WHEN turn = 2 THEN '  same note  ' WHEN turn = 5 THEN 'Same  Note' "
                   "WHEN turn = 7 THEN concat('饮食偏好：不要', role, '，预算 ', CAST(conv_id % 90 + 10 AS STRING)) "
                   "WHEN turn = 3 AND conv_id % 2 = 0 THEN concat('饮食偏好：喜欢', role) "
                   "WHEN turn = 6 AND conv_id % 4 = 0 THEN '   ' ELSE text END",
        "importance": "CAST(turn % 7 AS INT)",
        "epoch": "1700000000 + conv_id * 1000 + turn * 60",
    }),
    "tasks": ("orders", {
        "id": "o_orderkey",
        "owner": "o_custkey",
        "title": "concat(CASE o_orderkey % 4 WHEN 0 THEN '我这周要' WHEN 1 THEN '需要' WHEN 2 THEN ' 本周 ' ELSE '' END, "
                 "CASE WHEN o_orderkey % 37 = 0 THEN ' ， ' ELSE concat('Write Report ', CAST(o_orderkey % 11 AS STRING), '。') END)",
        "deadline": "CASE o_orderkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN concat('周', CASE o_orderkey % 4 WHEN 0 THEN '一' WHEN 1 THEN '三' WHEN 2 THEN '天' ELSE '五' END, '前交') "
                    "WHEN 2 THEN 'after the exam' ELSE concat('by ', CAST(CAST(o_orderdate AS DATE) AS STRING), '!') END",
        "priority": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' "
                    "WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'unknown' END",
        "status": "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END",
        "completed_at": "CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END",
        "due_day": "CAST(o_orderdate AS DATE)",
    }),
    "subtasks": ("lineitem", {
        "id": "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey % 1000 * 10 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END",
        "task_id": "l_orderkey",
        "title": "concat('step ', CAST(l_linenumber AS STRING), ' of ', CAST(l_partkey AS STRING))",
        "status": "CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'open' END",
    }),
    "job_events": ("events", {
        "event_id": "event_id",
        "job_id": "user_id",
        "document_id": "user_id % 50",
        "ts": "ts",
        "status": "CASE event_type WHEN 'view' THEN 'running' WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'retry_wait' "
                  "WHEN 'click' THEN 'cancelling' ELSE 'completed' END",
        "value": "value",
        "cancel_requested": "event_id % 11 = 0",
        "props": "props",
    }),
    "candidates": ("part", {
        "id": "p_partkey",
        "name": "p_name",
        "place": "p_brand",
        "category": "p_type",
        "price": "p_retailprice",
        "distance": "p_size",
        "weight": "p_size % 5 + 1",
        "enabled": "p_partkey % 17 <> 0",
    }),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    # Spark SQL reads a backslash in a literal as an escape, the checking SQL does not.
    return table(spark, sf_dir, source).selectExpr(
        *[f"{expr} AS `{alias}`".replace("\\", "\\\\") for alias, expr in columns.items()]
    )


def view_sql(*names: str) -> str:
    """The views as leading WITH clauses (without the keyword)."""
    parts = []
    for name in names:
        source, columns = VIEWS[name]
        body = ", ".join(f'{expr} AS "{alias}"' for alias, expr in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {source})")
    return ",\n".join(parts)


# Regular expression classes for the checking SQL.
WS = BLANK


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def key_sql(expr: str) -> str:
    return rf"lower(regexp_replace({expr}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def lines_sql(expr: str) -> str:
    return rf"string_split_regex({expr}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"


def spaced_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}+', ' ', 'g')"


def compact_sql(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '{WS}+', '', 'g')"


def any_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def present_sql(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, '{w}') AS INT)" for w in words) + ")"


def with_blocks(df: DataFrame, column: str = "body") -> DataFrame:
    """Paragraph structure for running text: every line break opens a new block."""
    return df.withColumn(column, F.replace(F.col(column), F.lit("\n"), F.lit("\n\n")))
