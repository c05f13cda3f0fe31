"""Page text as Columns: HTML to text, usability, length rules."""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from enrichspark import constants as C
from enrichspark.functions.keys import bind, trim_all

# Entities the JVM-only mode decodes; the ampersand comes last so that nothing is decoded twice.
NAMED_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}
# Comments, subtrees without visible text, and tags, in one pass. A text cut by any of them is two.
_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<({'|'.join(C.DROPPED_SUBTREES)})\b[^>]*+>.*?(?:</\1\s*+>|\z)"
    r"|<[!/?a-z][^>]*+>"
)
_LINE_BREAKS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]+"


# Subtrees of these may hold others of their kind; a plain pattern would end at the first closing tag.
_NESTING_TAG = r"(?i)</?(?:svg|template)\b[^>]*+>"
_NESTING_OPEN = r"(?i)<(?:svg|template)\b"


def _drop_nested(c: Column) -> Column:
    """Leave out subtrees that may be nested: text counts only outside of any. An unclosed one
    reaches to the end."""

    def deeper(depths: Column, tag: Column) -> Column:
        step = F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), 0).otherwise(1)
        return F.concat(depths, F.array(F.greatest(F.lit(0), F.element_at(depths, -1) + step)))

    def outside(markup: Column) -> Column:
        depths = F.aggregate(F.regexp_extract_all(markup, F.lit(_NESTING_TAG), F.lit(0)), F.array(F.lit(0)), deeper)
        parts = F.zip_with(F.split(markup, _NESTING_TAG), depths, lambda t, d: F.when(d == 0, t))
        return F.array_join(parts, "\n")

    # Comments and raw text first: tags inside them are none.
    bare = F.regexp_replace(c, r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript)\b[^>]*+>.*?(?:</\1\s*+>|\z)", "\n")
    return F.when(F.regexp_count(c, F.lit(_NESTING_OPEN)) > 1, bind(bare, outside)).otherwise(c)


@F.pandas_udf(StringType())
def _decode_all_entities(text: pd.Series) -> pd.Series:
    return text.map(_html.unescape, na_action="ignore")


# The same names count without their semicolon where no further name character follows.
_OPEN_ENTITY = r"&(lt|gt|quot|nbsp|copy|middot|amp)(?![A-Za-z0-9;.\-])"


def _decode_named(c: Column) -> Column:
    c = F.regexp_replace(c, _OPEN_ENTITY, "&$1;")
    for entity, char in NAMED_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_text(c: Column, mode: str = "full") -> Column:
    """Visible text of a page, one trimmed non-blank line per text node.

    ``full`` decodes every entity in an Arrow batch function; ``named`` stays in the JVM and
    decodes the usual ones; ``raw`` hands the markup on unchanged.
    """
    if mode == "raw":
        return c
    t = F.regexp_replace(_drop_nested(c), _MARKUP, "\n")
    t = _decode_all_entities(t) if mode == "full" else _decode_named(t)
    lines = F.transform(F.split(t, _LINE_BREAKS), trim_all)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def strip_tags(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", ""))


def excerpt(c: Column, n: int = C.EXCERPT_CHARS) -> Column:
    return F.substring(c, 1, n)


def body_length(c: Column) -> Column:
    return F.length(trim_all(F.coalesce(c, F.lit(""))))


def usable(c: Column) -> Column:
    """Long enough, and not a short page that shows a script wall or bot check."""
    body = trim_all(F.coalesce(c, F.lit("")))
    markers = "|".join(re.escape(m) for m in C.SHELL_MARKERS)
    walled = F.lower(F.substring(body, 1, C.SHELL_TEST_PREFIX)).rlike(markers)
    return (F.length(body) >= C.MIN_USABLE_CHARS) & ~((F.length(body) < C.SHELL_TEST_BELOW) & walled)


def long_enough(c: Column, n: int) -> Column:
    return body_length(c) >= n


def is_dead(status: Column) -> Column:
    return F.coalesce(status.isin(*C.DEAD_STATUSES), F.lit(False))


def is_shell(content: Column, ok: Column, status: Column) -> Column:
    """An answer that is neither usable nor dead but still holds some text."""
    return ~(ok & usable(content)) & ~is_dead(status) & (body_length(content) > 0)


def needs_digest(content: Column, from_cache: Column, threshold: int = C.DIGEST_THRESHOLD) -> Column:
    return ~from_cache & (F.length(content) > threshold)


def truncated(content: Column, threshold: int = C.DIGEST_THRESHOLD) -> Column:
    cut = F.concat(F.substring(content, 1, threshold), F.lit(C.TRUNCATION_SUFFIX))
    return F.when(F.length(content) > threshold, cut).otherwise(content)


def squeeze(c: Column) -> Column:
    """Lower-cased text with white space collapsed, for containment tests."""
    return trim_all(F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " "))


# --- table jobs -------------------------------------------------------------


def with_page_text(df: DataFrame, col: str = "html", mode: str = "full", out: str = "content") -> DataFrame:
    return df.withColumn(out, html_text(F.col(col), mode))


def with_usable(df: DataFrame, col: str = "content") -> DataFrame:
    return df.withColumn("usable", usable(F.col(col)))


def with_min_len(df: DataFrame, n: int, col: str = "content") -> DataFrame:
    return df.withColumn("long_enough", long_enough(F.col(col), n))


def with_dead(df: DataFrame, col: str = "http_status") -> DataFrame:
    return df.withColumn("is_dead", is_dead(F.col(col)))


def with_shell(df: DataFrame) -> DataFrame:
    return df.withColumn("is_js_shell", is_shell(F.col("content"), F.col("ok"), F.col("status")))


def truncate_long(df: DataFrame, n: int = C.DIGEST_THRESHOLD, col: str = "content") -> DataFrame:
    return df.withColumn(col, truncated(F.col(col), n))
