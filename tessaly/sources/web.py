"""Parsing of raw HTML: result lists and outlines."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaly.functions.text import single_spaced, strip

# The markup of two result list formats (block, link with url and title, snippet).
RESULT_FORMATS = {
    "results_links": (
        r'(?s)<div class="result results_links.*?</div>\s*</div>',
        r'(?s)class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>',
        r'(?s)class="result__snippet"[^>]*>(.*?)</',
    ),
    "b_algo": (
        r'(?s)<li class="b_algo".*?</li>',
        r'(?s)<h2[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>',
        r"(?s)<p[^>]*>(.*?)</p>",
    ),
}


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    """All named and numeric character references (there is no built-in for the full table)."""
    return values.map(html.unescape, na_action="ignore")


def plain_text(value: Column) -> Column:
    return strip(single_spaced(F.regexp_replace(unescape(value), r"<[^>]+>", "")))


def direct_url(value: Column) -> Column:
    """Target of a redirect link, or the link itself."""
    link = unescape(value)
    target = F.try_url_decode(F.regexp_extract(link, r"[?&]uddg=([^&#]*)", 1))
    again = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    return F.when(F.coalesce(target, F.lit("")) == "", link).otherwise(again)


def result_items(pages: DataFrame, form: str, limit: int, source: str = "html") -> DataFrame:
    """First results of each page: position, title, url, snippet. Blocks without a link do not count."""
    block, link, snippet = RESULT_FORMATS[form]
    blocks = F.slice(
        F.filter(F.regexp_extract_all(F.col(source), F.lit(block), F.lit(0)), lambda b: b.rlike(link)), 1, limit
    )
    keep = [c for c in pages.columns if c != source]
    items = pages.select(*keep, F.posexplode(blocks).alias("position", "_b"))
    url = F.regexp_extract("_b", link, 1)
    return items.select(
        *keep, (F.col("position") + 1).alias("position"), plain_text(F.regexp_extract("_b", link, 2)).alias("title"),
        (direct_url(url) if form == "results_links" else unescape(url)).alias("url"),
        plain_text(F.regexp_extract("_b", snippet, 1)).alias("snippet"),
    )


def html_outline(pages: DataFrame, source: str = "html") -> DataFrame:
    """Headings 1 to 3 with id and plain label; one default entry when there is none."""
    pattern = r'(?s)<h([1-3]) id="([^"]+)">(.*?)</h\1>'
    group = lambda n: F.regexp_extract_all(F.col(source), F.lit(pattern), F.lit(n))
    zipped = F.arrays_zip(group(1).alias("level"), group(2).alias("section_id"), group(3).alias("raw"))
    keep = [c for c in pages.columns if c != source]
    rows = pages.select(*keep, F.posexplode_outer(zipped).alias("position", "h"))
    label = unescape(F.regexp_replace("h.raw", r"<[^>]+>", ""))
    return rows.select(
        *keep, F.coalesce("position", F.lit(0)).alias("position"), F.coalesce(F.col("h.level").cast("int"), F.lit(1)).alias("level"),
        F.coalesce("h.section_id", F.lit("document-start")).alias("section_id"),
        F.when(F.col("h.level").isNull(), "00_原文").otherwise(label).alias("label"),
    )
