"""Stored provider answers, in eight shapes, to one array of (title, url, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import non_blank, url_decode
from enrichspark.functions.text import long_enough, strip_tags

RESULT_TYPE = "array<struct<title:string,url:string,content:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _result(title: Column, url: Column, content: Column) -> Column:
    return F.struct(_text(title).alias("title"), _text(url).alias("url"), _text(content).alias("content"))


def _results(items: Column, build, n: int | None) -> Column:
    """Uniform rows, in vendor rank; a payload that does not parse gives none."""
    rows = F.transform(F.coalesce(items, F.array()), build)
    return F.slice(rows, 1, n) if n else rows


def _text_or_list(raw: Column, glue: str) -> Column:
    """A field that is a text or a list of texts, empty counted as absent."""
    joined = F.array_join(F.from_json(raw, "array<string>"), glue)
    return non_blank(F.when(raw.startswith("["), F.coalesce(joined, raw)).otherwise(raw))


def lite_html(payload: Column, status: Column, n: int | None = None) -> Column:
    """Result-page HTML: links and snippets paired by position, redirects unwrapped."""

    def target(url: Column) -> Column:
        param = F.regexp_extract(url, C.LITE_REDIRECT_PARAM, 1)
        # Path decoding keeps '+' as it is.
        plain = url_decode(F.replace(param, F.lit("+"), F.lit("%2B")))
        return F.when(F.contains(url, F.lit(C.LITE_REDIRECT)) & (param != ""), plain).otherwise(url)

    link, snippet = F.lit(f"(?s){C.LITE_LINK}"), F.lit(f"(?s){C.LITE_SNIPPET}")
    blocked = F.lower(payload).rlike("|".join(C.LITE_BLOCK_WORDS))
    urls = F.regexp_extract_all(payload, link, F.lit(1))
    titles = F.regexp_extract_all(payload, link, F.lit(2))
    snippets = F.slice(F.regexp_extract_all(payload, snippet, F.lit(1)), F.lit(1), F.size(urls))
    zipped = F.arrays_zip(urls.alias("u"), titles.alias("t"), snippets.alias("s"))
    rows = _results(
        zipped, lambda r: _result(strip_tags(r["t"]), target(r["u"]), strip_tags(r["s"])), n
    )
    usable = F.coalesce((status == 200) & ~blocked, F.lit(False))
    return F.when(usable, rows).otherwise(F.array().cast(RESULT_TYPE))


def web_results(payload: Column, n: int | None = None) -> Column:
    schema = "web struct<results:array<struct<title:string,url:string,description:string>>>"
    items = F.from_json(payload, schema)["web"]["results"]
    return _results(items, lambda r: _result(r["title"], r["url"], strip_tags(r["description"])), n)


def organic(payload: Column, n: int | None = None) -> Column:
    items = F.from_json(payload, "organic array<struct<title:string,link:string,snippet:string>>")["organic"]
    return _results(items, lambda r: _result(r["title"], r["link"], r["snippet"]), n)


def embedded_array(payload: Column, n: int | None = None) -> Column:
    """First to last bracket of a text answer, which may itself sit in an envelope."""
    envelope = F.when(F.ltrim(payload).startswith("{"), F.get_json_object(payload, "$.result"))
    text = F.coalesce(envelope, payload)
    array = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    # Elements are read as raw text first, so that one odd element does not spoil the rest.
    objects = F.filter(F.from_json(array, "array<string>"), lambda e: F.ltrim(e).startswith("{"))
    items = F.transform(
        objects, lambda e: F.from_json(e, "title string, url string, snippet string")
    )
    return _results(items, lambda r: _result(r["title"], r["url"], r["snippet"]), n)


def text_or_snippet(payload: Column, n: int | None = None) -> Column:
    schema = "results array<struct<title:string,url:string,text:string,snippet:string>>"
    items = F.from_json(payload, schema)["results"]

    def build(r: Column) -> Column:
        body = F.coalesce(non_blank(r["text"]), non_blank(r["snippet"]), F.lit(""))
        return _result(r["title"], r["url"], F.substring(body, 1, C.RESULT_CHARS))

    return _results(items, build, n)


def excerpts(payload: Column, n: int | None = None) -> Column:
    schema = (
        "results array<struct<title:string,url:string,excerpts:string,excerpt:string,content:string>>"
    )
    items = F.from_json(payload, schema)["results"]

    def build(r: Column) -> Column:
        body = F.coalesce(*[_text_or_list(r[f], " ") for f in ("excerpts", "excerpt", "content")], F.lit(""))
        return _result(r["title"], r["url"], F.substring(body, 1, C.RESULT_CHARS))

    return _results(items, build, n)


def plain(payload: Column, n: int | None = None) -> Column:
    items = F.from_json(payload, f"results {RESULT_TYPE}")["results"]
    return _results(items, lambda r: _result(r["title"], r["url"], r["content"]), n)


def extract_body(payload: Column) -> Column:
    """Body of a one-page extract: the first item of results, else of extracts."""
    item = "array<struct<excerpts:string,content:string,markdown:string>>"
    doc = F.from_json(payload, f"results {item}, extracts {item}")
    items = F.when(F.size(doc["results"]) > 0, doc["results"]).otherwise(doc["extracts"])
    first = F.get(items, F.lit(0))
    return F.coalesce(
        *[_text_or_list(first[f], "\n\n") for f in ("excerpts", "content", "markdown")], F.lit("")
    )


def extract_body_ok(body: Column) -> Column:
    return long_enough(body, C.EXTRACT_MIN_CHARS)


def raw_content_pairs(payload: Column) -> Column:
    """(url, raw_content) pairs of a batched extract; a pair missing either is dropped."""
    items = F.from_json(payload, "results array<struct<url:string,raw_content:string>>")["results"]
    return F.filter(
        F.coalesce(items, F.array()),
        lambda r: (F.coalesce(r["url"], F.lit("")) != "") & (F.coalesce(r["raw_content"], F.lit("")) != ""),
    )


READERS = {
    "ddg": lambda payload, status, n: lite_html(payload, status, n),
    "brave": lambda payload, status, n: web_results(payload, n),
    "serper": lambda payload, status, n: organic(payload, n),
    "claude_cli": lambda payload, status, n: embedded_array(payload, n),
    "exa": lambda payload, status, n: text_or_snippet(payload, n),
    "parallel": lambda payload, status, n: excerpts(payload, n),
    "tavily": lambda payload, status, n: plain(payload, n),
}


def read_payload(provider: Column, payload: Column, status: Column, n: int | None = None) -> Column:
    """The uniform results of any provider's stored answer; anything but a 200 is empty."""
    empty = F.array().cast(RESULT_TYPE)
    chosen = None
    for name, reader in READERS.items():
        rows = reader(payload, status, n)
        chosen = F.when(provider == name, rows) if chosen is None else chosen.when(provider == name, rows)
    return F.when(F.coalesce(status == 200, F.lit(False)), F.coalesce(chosen.otherwise(empty), empty)).otherwise(empty)
