"""Canonical URL, query and domain keys as Columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark import constants as C

# Every character a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_ALL = 1 << 30  # to the end of the text
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def trim_all(c: Column) -> Column:
    """Strip every kind of white space; Spark's plain trim removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_blank(c: Column) -> Column:
    """The value, or NULL where it is empty."""
    return F.nullif(c, F.lit(""))


def url_decode(c: Column) -> Column:
    """Percent-decoding that leaves a stray percent sign alone."""
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _url_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_TRACKING_NAME = rf"^(?:(?:{'|'.join(C.TRACKING_PREFIXES)})|(?:{'|'.join(C.TRACKING_NAMES)})$)"
_TRACKED = rf"(?:^|&)(?:{'|'.join(C.TRACKING_PREFIXES)}|(?:{'|'.join(C.TRACKING_NAMES)})=)"
# A character that needs decoding or encoding, or a pair that is empty or has not exactly one "=" after a name.
_UNCLEAN = r"[^A-Za-z0-9_.~\-=&]|^&|&$|&&|(?:^|&)=|(?:^|&)[^=&]*(?:&|$)|=[^&]*="


def _clean_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            url_decode(F.substring_index(p, "=", 1)).alias("k"),
            url_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].rlike(_TRACKING_NAME))
    encoded = F.transform(kept, lambda p: F.concat(_url_encode(p["k"]), F.lit("="), _url_encode(p["v"])))
    # Most queries need no work at all.
    clean = ~query.rlike(_UNCLEAN) & ~query.rlike(_TRACKED)
    return F.when((query == "") | clean, query).otherwise(F.array_join(encoded, "&"))


# --- canonical URL, step by step ------------------------------------------------
# A step names new values in terms of earlier ones, each computed once. The steps run as columns
# of a table (compiled by Spark) or, inside one Column, as fields of a bound struct.

Values = Mapping[str, Column]


def _url_ends(v: Values) -> dict[str, Column]:
    return {
        "usual": v["url"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"),
        "full": F.substring_index(v["url"], "#", 1),
    }


def _url_core(v: Values) -> dict[str, Column]:
    return {"core": F.substring_index(v["full"], "?", 1)}


def _url_scheme(v: Values) -> dict[str, Column]:
    """Plain cuts for the usual ``scheme://`` form, the general pattern for the rest."""
    scheme = F.substring_index(v["core"], "://", 1)
    general = F.coalesce(non_blank(F.lower(F.regexp_extract(v["url"], _URL, 1))), F.lit("https"))
    after = F.substring(v["core"], F.length(scheme) + 4, _ALL)
    query = F.substring(v["full"], F.length(v["core"]) + 2, _ALL)
    return {
        "scheme": F.when(v["usual"], F.lower(scheme)).otherwise(general),
        "after": F.when(v["usual"], after),
        "query": F.when(v["usual"], query).otherwise(F.regexp_extract(v["url"], _URL, 4)),
    }


def _url_authority(v: Values) -> dict[str, Column]:
    usual = F.substring_index(v["after"], "/", 1)
    return {"authority": F.when(v["usual"], usual).otherwise(F.regexp_extract(v["url"], _URL, 2))}


def _url_path(v: Values) -> dict[str, Column]:
    usual = F.substring(v["after"], F.length(v["authority"]) + 1, _ALL)
    path = F.when(v["usual"], usual).otherwise(F.regexp_extract(v["url"], _URL, 3))
    return {
        "path": F.rtrim(path, F.lit("/")),
        "address": F.substring_index(v["authority"], "@", -1),
        "kept": _clean_query(v["query"]),
    }


def _url_host(v: Values) -> dict[str, Column]:
    bracketed = F.contains(v["address"], F.lit("["))
    v6 = F.regexp_extract(v["address"], r"\[([^\]]*)", 1)
    host = F.when(bracketed, v6).otherwise(F.substring_index(v["address"], ":", 1))
    return {"host": F.lower(host), "bracketed": bracketed}


def _url_port(v: Values) -> dict[str, Column]:
    v6 = F.regexp_extract(v["address"], r"\][^:]*:(.*)$", 1)
    usual = F.substring(v["address"], F.length(v["host"]) + 2, _ALL)
    return {"port": F.when(v["bracketed"], v6).otherwise(usual)}


def _url_number(v: Values) -> dict[str, Column]:
    return {"number": F.when(v["port"].rlike(r"^[0-9]+$"), v["port"].try_cast("int"))}


def _url_netloc(v: Values) -> dict[str, Column]:
    shown = F.coalesce(v["number"] != 0, F.lit(False))
    for scheme, port in C.DEFAULT_PORTS.items():
        shown = shown & ~((v["scheme"] == scheme) & (v["number"] == port))
    suffix = F.when(shown, F.concat(F.lit(":"), v["number"].cast("string"))).otherwise("")
    valid = (v["port"] == "") | F.coalesce(v["number"] <= 65535, F.lit(False))
    return {"netloc": F.when(valid, F.concat(v["host"], suffix))}


def _url_whole(v: Values) -> dict[str, Column]:
    # Without a host only the bare root keeps the double slash.
    rooted = (v["netloc"] != "") | (v["path"] == "")
    slashes = F.when(rooted, "://").otherwise(":")
    root = F.when(rooted & ~v["path"].startswith("/"), "/").otherwise("")
    query = F.when(v["kept"] == "", "").otherwise(F.concat(F.lit("?"), v["kept"]))
    return {"whole": F.concat(v["scheme"], slashes, v["netloc"], root, v["path"], query)}


_URL_STEPS = (
    _url_ends,
    _url_core,
    _url_scheme,
    _url_authority,
    _url_path,
    _url_host,
    _url_port,
    _url_number,
    _url_netloc,
    _url_whole,
)


def _url_seed(c: Column) -> Column:
    return F.translate(trim_all(c), "\t\r\n", "")


def canon_url(c: Column) -> Column:
    """Canonical URL: one spelling for all variants of an address.

    Scheme and host lower-cased, user info, default port, fragment, trailing slashes and
    tracking parameters dropped, remaining parameters re-encoded in order. A port that is
    not a number up to 65535 makes the result NULL. ``with_canon_url`` does the same to a table
    and is the faster of the two.
    """
    value, names = F.struct(_url_seed(c).alias("url")), ["url"]
    for step in _URL_STEPS:
        made: list[str] = []

        def grown(s: Column) -> Column:
            have = {n: s[n] for n in names}
            new = step(have)
            made.extend(n for n in new if n not in have)
            return F.struct(*[x.alias(n) for n, x in {**have, **new}.items()])

        value = bind(value, grown)
        names = names + made
    return value["whole"]


def with_canon_url(df: DataFrame, col: str = "url", out: str = "canon_url") -> DataFrame:
    """``canon_url`` of a column, as compiled columns of the table."""
    mark = "__u_"
    steps = df.withColumn(f"{mark}url", _url_seed(F.col(col)))
    names = ["url"]
    for step in _URL_STEPS:
        new = step({n: F.col(mark + n) for n in names})
        steps = steps.withColumns({mark + n: x for n, x in new.items()})
        names += [n for n in new if n not in names]
    return steps.withColumn(out, F.col(f"{mark}whole")).drop(*[mark + n for n in names])


def _key(text: Column, raw: Column) -> Column:
    """sha256 of a canonical text. A value without one gets a key of its own, so that no row is
    lost in a join; being never NULL also spares joins a filter that would compute it twice."""
    named = F.coalesce(text, F.concat(F.lit("not canonical: "), raw), F.lit("not canonical"))
    return F.coalesce(F.sha2(named, 256), F.lit(""))


def url_key(c: Column) -> Column:
    return _key(canon_url(c), c)


def canon_query(c: Column) -> Column:
    """Lower-cased query with white space collapsed; NULL becomes empty."""
    return trim_all(F.regexp_replace(F.lower(_or_blank(c)), _WS_RUN, " "))


def query_key(c: Column, rung: str = C.SEARCH_CACHE_RUNG) -> Column:
    return _key(F.concat(F.lit(f"{rung}|"), canon_query(c)), c)


def cached_body(digest: Column, excerpt: Column) -> Column:
    """What a cache row holds for the reader: the digest, else the excerpt, else nothing."""
    return F.coalesce(non_blank(digest), non_blank(excerpt), F.lit(""))


def content_key(digest: Column, excerpt: Column) -> Column:
    return F.sha2(cached_body(digest, excerpt), 256)


def canon_domain(c: Column) -> Column:
    """Bare host of a domain or URL; NULL where nothing is left."""
    d = F.regexp_replace(F.lower(trim_all(c)), r"^https?://", "")
    d = F.regexp_replace(F.substring_index(d, "/", 1), r"^www\.", "")
    return non_blank(F.rtrim(d, F.lit(".")))


def url_host(c: Column) -> Column:
    """Lower-cased host of an absolute URL, NULL if it has none."""
    return non_blank(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


# --- table jobs -------------------------------------------------------------


def with_url_key(df: DataFrame, col: str = "url", out: str = "url_key") -> DataFrame:
    rows = with_canon_url(df, col, "__canon")
    return rows.withColumn(out, _key(F.col("__canon"), F.col(col))).drop("__canon")


def with_canon_query(df: DataFrame, col: str = "query") -> DataFrame:
    return df.withColumn("canon_query", canon_query(F.col(col)))


def with_query_key(df: DataFrame, rung: str = C.SEARCH_CACHE_RUNG, col: str = "query") -> DataFrame:
    return df.withColumn("query_key", query_key(F.col(col), rung))


def with_content_key(df: DataFrame) -> DataFrame:
    return df.withColumn("content_key", content_key(F.col("digest"), F.col("raw_excerpt")))


def with_canon_domain(df: DataFrame, col: str = "domain") -> DataFrame:
    return df.withColumn("canon_domain", canon_domain(F.col(col)))


def register_sql_functions(spark: SparkSession, known_view: str | None = None) -> None:
    """SQL names for the domain rule and, over a view of known companies, the batch lookup."""
    spark.sql(
        r"""
        CREATE OR REPLACE TEMPORARY FUNCTION normalize_company_domain(d STRING) RETURNS STRING
        RETURN nullif(rtrim('.', regexp_replace(substring_index(
          regexp_replace(lower(trim(d)), '^https?://', ''), '/', 1), '^www\\.', '')), '')
        """
    )
    if known_view:
        _domain_check(spark, "check_company_domains", known_view)


def _domain_check(spark: SparkSession, name: str, known_view: str) -> None:
    # rows without a domain get stand-in keys, which match nothing: with a salt per row they do not meet in one task
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(domains ARRAY<STRING>, salt BIGINT DEFAULT 0)
        RETURNS TABLE(input_domain STRING, status STRING, company_name STRING, notes STRING)
        RETURN SELECT d.dom, coalesce(k.status, '{C.NET_NEW}'), k.company_name, k.notes
        FROM explode(domains) AS d(dom) LEFT JOIN {known_view} k
        ON coalesce(normalize_company_domain(d.dom), concat(chr(0), cast(salt AS STRING))) = k.domain_normalized
        """
    )


def register_domain_check(spark: SparkSession, known: DataFrame) -> str:
    """The batch lookup over these known companies, as a SQL table function under a name of this call's own.

    ``known`` has one row per ``domain_normalized``. Jobs in one session do not see each other's companies.
    """
    register_sql_functions(spark)
    mark = uuid.uuid4().hex
    known.createOrReplaceTempView(f"known_{mark}")
    _domain_check(spark, f"check_company_domains_{mark}", f"known_{mark}")
    return f"check_company_domains_{mark}"
