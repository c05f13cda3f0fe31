"""Stored provider answers to uniform rows.

Every page's links are packed into an answer of each shape and unpacked again, so the check is
the links themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions import payloads
from enrichspark.plans import oracle as q
from enrichspark.plans.registry import query
from enrichspark.sources.derived import Derived


def _rows(content: str, where: str = "true") -> str:
    return f"select page_id, nth as rank, label as title, href as url, {content} as content from anchor where {where}"


def _ranked(df: DataFrame, results: Column) -> DataFrame:
    rows = df.select("page_id", F.posexplode(results).alias("_i", "r"))
    return rows.select("page_id", (F.col("_i") + 1).cast("long").alias("rank"), "r.title", "r.url", "r.content")


def _items(*fields: tuple[str, str]) -> Column:
    """The page's links as objects; each field is the label or the target of the link."""
    return F.transform("links", lambda a: F.struct(*[a[source].alias(name) for name, source in fields]))


def _json(d: Derived, **parts: Column) -> DataFrame:
    doc = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return d.anchor.select("page_id", doc.alias("payload"))



@query("norm_lite_html", _rows("case when nth < cnt then 'About ' || label else '' end").replace("from anchor", "from (select *, max(nth) over (partition by page_id) as cnt from anchor)"), "anchor")
def norm_lite_html(d: Derived) -> DataFrame:
    """Result-page HTML with redirects; the last link has no snippet."""
    link = lambda a: F.concat(
        F.lit('<a rel="nofollow" href="//duckduckgo.com/l/?uddg='),
        F.url_encode(a["href"]),
        F.lit("&amp;rut=1\" class='result-link'><b>"),
        a["label"],
        F.lit("</b></a>\n"),
    )
    snippet = lambda a: F.concat(F.lit("<td class='result-snippet'>About <i>"), a["label"], F.lit("</i></td>\n"))
    shown = F.slice("links", F.lit(1), F.greatest(F.size("links") - 1, F.lit(0)))
    page = F.concat(F.array_join(F.transform("links", link), ""), F.array_join(F.transform(shown, snippet), ""))
    pages = d.anchor.select("page_id", page.alias("payload"))
    return _ranked(pages, payloads.lite_html(F.col("payload"), F.lit(200)))


@query("norm_web_results", _rows("'About ' || label"), "anchor")
def norm_web_results(d: Derived) -> DataFrame:
    items = F.transform(
        "links",
        lambda a: F.struct(
            a["label"].alias("title"),
            a["href"].alias("url"),
            F.concat(F.lit(" About <strong>"), a["label"], F.lit("</strong> ")).alias("description"),
        ),
    )
    docs = _json(d, web=F.struct(items.alias("results")))
    return _ranked(docs, payloads.web_results(F.col("payload")))


@query("norm_organic", _rows("label"), "anchor")
def norm_organic(d: Derived) -> DataFrame:
    docs = _json(d, organic=_items(("title", "label"), ("link", "href"), ("snippet", "label")))
    return _ranked(docs, payloads.organic(F.col("payload")))


@query("norm_embedded_array", _rows("label"), "anchor")
def norm_embedded_array(d: Derived) -> DataFrame:
    """An array inside prose; on even pages the prose sits in an envelope."""
    array = F.to_json(_items(("title", "label"), ("url", "href"), ("snippet", "label")))
    prose = F.concat(F.lit("Here you go:\n"), array, F.lit("\nDone."))
    envelope = F.to_json(F.struct(F.lit("success").alias("type"), prose.alias("result")))
    payload = F.when(F.pmod("page_id", F.lit(2)) == 0, envelope).otherwise(prose)
    docs = d.anchor.select("page_id", payload.alias("payload"))
    return _ranked(docs, payloads.embedded_array(F.col("payload")))


@query("norm_text_or_snippet", _rows("case when nth % 2 = 0 then href else label end"), "anchor")
def norm_text_or_snippet(d: Derived) -> DataFrame:
    """Odd items have a text; even ones an empty text and a snippet."""
    items = F.transform(
        "links",
        lambda a, i: F.struct(
            a["label"].alias("title"),
            a["href"].alias("url"),
            F.when(i % 2 == 0, a["label"]).otherwise("").alias("text"),
            a["href"].alias("snippet"),
        ),
    )
    return _ranked(_json(d, results=items), payloads.text_or_snippet(F.col("payload")))


@query(
    "norm_excerpts",
    _rows("case nth % 3 when 1 then substr(label || ' ' || href || ' ' || repeat('x', 700), 1, 600) when 2 then label else href end"),
    "anchor",
)
def norm_excerpts(d: Derived) -> DataFrame:
    """Items in turn with a list of excerpts, one excerpt, or only content."""
    long_ = F.lit("x" * 700)
    items = F.transform(
        "links",
        lambda a, i: F.struct(
            a["label"].alias("title"),
            a["href"].alias("url"),
            F.when(i % 3 == 0, F.array(a["label"], a["href"], long_)).alias("excerpts"),
            F.when(i % 3 == 1, a["label"]).alias("excerpt"),
            a["href"].alias("content"),
        ),
    )
    return _ranked(_json(d, results=items), payloads.excerpts(F.col("payload")))


@query(
    "norm_extract_body",
    f"""select page_id, body, length({q.strip('body')}) >= 200 as ok from (
      select page_id, case page_id % 3 when 0 then url || chr(10) || chr(10) || content when 1 then content else 'md ' || content end as body
      from page_text)""",
    "page_text",
)
def norm_extract_body(d: Derived) -> DataFrame:
    """One page per answer: list of excerpts, plain content, or markdown under the other name."""
    kind = F.pmod("page_id", F.lit(3))
    listed = F.when(kind == 0, F.array("url", "content"))
    main = F.array(F.struct(listed.alias("excerpts"), F.when(kind == 1, F.col("content")).alias("content")))
    other = F.array(F.struct(F.concat(F.lit("md "), "content").alias("markdown")))
    doc = F.struct(
        F.when(kind < 2, main).otherwise(F.slice(main, 1, 0)).alias("results"), other.alias("extracts")
    )
    docs = d.page_text.select("page_id", F.to_json(doc).alias("payload"))
    body = docs.select("page_id", payloads.extract_body(F.col("payload")).alias("body"))
    return body.withColumn("ok", payloads.extract_body_ok(F.col("body")))


@query(
    "norm_raw_content",
    "select page_id, href as url, label as raw_content from anchor where nth % 3 <> 0 and label <> ''",
    "anchor",
)
def norm_raw_content(d: Derived) -> DataFrame:
    """A batched extract in which every third page came back without content."""
    items = F.transform(
        "links",
        lambda a, i: F.struct(a["href"].alias("url"), F.when(i % 3 != 2, a["label"]).alias("raw_content")),
    )
    docs = _json(d, results=items)
    pairs = payloads.raw_content_pairs(F.col("payload"))
    return docs.select("page_id", F.inline(pairs))


@query("norm_plain", _rows("case when nth % 2 = 1 then label else '' end"), "anchor")
def norm_plain(d: Derived) -> DataFrame:
    items = F.transform(
        "links",
        lambda a, i: F.struct(
            a["label"].alias("title"), a["href"].alias("url"), F.when(i % 2 == 0, a["label"]).alias("content")
        ),
    )
    return _ranked(_json(d, results=items), payloads.plain(F.col("payload")))


@query("topn_results", _rows("label", f"nth <= {C.LIBRARY_RESULTS}"), "anchor")
def topn_results(d: Derived) -> DataFrame:
    """First results in vendor rank: the limit is the request's own."""
    docs = _json(d, organic=_items(("title", "label"), ("link", "href"), ("snippet", "label")))
    return _ranked(docs, payloads.organic(F.col("payload"), C.LIBRARY_RESULTS))


@query(
    "payload_json",
    "select page_id, provider, status = 200 and n > 0 as ok, case when status = 200 then n else 0 end as results from ("
    "select p.page_id, case p.page_id % 3 when 0 then 'serper' when 1 then 'brave' else 'tavily' end as provider, "
    "case when p.page_id % 7 = 0 then 500 else 200 end as status, "
    "case when p.page_id % 11 = 0 then 0 else coalesce(a.n, 0) end as n from pages p "
    "left join (select page_id, count(*) as n from anchor group by 1) a using (page_id))",
    "anchor",
)
def payload_json(d: Derived) -> DataFrame:
    """Answers of three providers through one reader; failed and broken ones come out empty."""
    pid = F.col("page_id")
    kind = F.pmod(pid, F.lit(3))
    organic = F.to_json(F.struct(_items(("title", "label"), ("link", "href"), ("snippet", "label")).alias("organic")))
    items = _items(("title", "label"), ("url", "href"), ("description", "label"))
    web = F.to_json(F.struct(F.struct(items.alias("results")).alias("web")))
    plain = F.to_json(F.struct(_items(("title", "label"), ("url", "href"), ("content", "label")).alias("results")))
    whole = F.when(kind == 0, organic).when(kind == 1, web).otherwise(plain)
    rows = d.anchor.select(
        "page_id",
        F.when(kind == 0, "serper").when(kind == 1, "brave").otherwise("tavily").alias("provider"),
        F.when(F.pmod(pid, F.lit(7)) == 0, 500).otherwise(200).alias("status"),
        F.when(F.pmod(pid, F.lit(11)) == 0, "<html>oops").otherwise(whole).alias("payload"),
    )
    results = payloads.read_payload(F.col("provider"), F.col("payload"), F.col("status"))
    n = F.size(results)
    return rows.select("page_id", "provider", (n > 0).alias("ok"), n.cast("long").alias("results"))
