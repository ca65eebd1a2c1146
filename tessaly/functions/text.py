"""Unicode-aware text helpers, all plain column expressions.

Java regular expressions are ASCII-only unless told otherwise, so every class here is
spelled out: letters and digits of any script count as word characters, and the blank
class covers every Unicode space plus the four ASCII separators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The characters of ``BLANK`` one by one.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
NON_WORD = r"[^\p{L}\p{N}]+"
PAGE_ANCHOR = r"(?i)<!--\s*page\s*:\s*(\d+)\s*-->"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove blanks of any kind at both ends. Only the ends are looked at; a pattern would try every blank of the text."""
    return F.btrim(as_column(value), F.lit(BLANKS))


def lines(value: Column | str) -> Column:
    return F.split(as_column(value), LINE_BREAK, -1)


def blocks(value: Column | str) -> Column:
    """Paragraph blocks: pieces between two or more line feeds."""
    return F.split(as_column(value), r"\n{2,}", -1)


def bare_key(value: Column | str) -> Column:
    """Letters and digits only, lower-cased: the comparison key of headings and lines."""
    return F.lower(F.regexp_replace(as_column(value), NON_WORD, ""))


def single_spaced(value: Column | str) -> Column:
    return F.regexp_replace(as_column(value), rf"{BLANK}+", " ")


def folded_space(value: Column | str) -> Column:
    """Blank runs become one space, ends stripped, case folded."""
    return F.replace(F.lower(strip(single_spaced(value))), F.lit("ß"), F.lit("ss"))


def compact(value: Column | str) -> Column:
    """All blanks removed, lower-cased."""
    return F.regexp_replace(F.lower(as_column(value)), rf"{BLANK}+", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. A plain column used inside a lambda is
    computed again for every element; a lambda argument is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(value: Column, words: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | value.contains(word)
    return found


def count_present(value: Column, words: tuple[str, ...] | list[str]) -> Column:
    """How many of the words occur at least once."""
    total = F.lit(0)
    for word in words:
        total = total + value.contains(word).cast("int")
    return total


def remove_all(value: Column, words: tuple[str, ...] | list[str]) -> Column:
    for word in words:
        value = F.replace(value, F.lit(word), F.lit(""))
    return value


def blank_to_null(value: Column) -> Column:
    return F.when(value == "", None).otherwise(value)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ordered_join(separator: str, position: Column, value: Column) -> Column:
    """Aggregate: values joined in position order (for groups bounded by one document row)."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda x: x["v"]),
        separator,
    )


def dollar_math(value: Column | str) -> Column:
    """Old math delimiters become dollar signs, across line ends."""
    inline = F.regexp_replace(as_column(value), r"(?s)\\\((.+?)\\\)", r"\$$1\$")
    return F.regexp_replace(inline, r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$")


def unquoted(value: Column | str) -> Column:
    """Leading quote marks of every line removed."""
    return F.regexp_replace(as_column(value), r"(?m)^[ \t]*>+[ \t]?", "")


def clean_heading(value: Column | str) -> Column:
    trimmed = strip(F.regexp_replace(as_column(value), rf"{BLANK}+#+{BLANK}*$", ""))
    return F.coalesce(blank_to_null(trimmed), F.lit("未命名章节"))


def regex_literal(value: Column | str) -> Column:
    """A value as a regular expression matching exactly itself."""
    return F.concat(F.lit(r"\Q"), as_column(value), F.lit(r"\E"))


def by(*specs: str) -> list[Column]:
    """Sort columns from names; a leading minus means descending."""
    return [F.col(s[1:]).desc() if s.startswith("-") else F.col(s).asc() for s in specs]
