import datetime as dt

import pytest

from enrichspark.functions.keys import url_key
from enrichspark.operators import cache
from enrichspark.sources.tables import SCHEMAS

AS_OF = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 2, 1)
DAY = dt.timedelta(days=1)


def page(key, expires, **kw):
    base = dict(url=f"u-{key}", content_hash="h", http_status=200, is_dead=False, provider="native", digest=None)
    base |= dict(raw_excerpt="body", fetched_at=NOW - DAY, fetch_count=3)
    base |= kw
    names = [c.split()[0] for c in SCHEMAS["page_cache"].split(", ")]
    return tuple({"url_key": key, "expires_at": expires, **base}[n] for n in names)


@pytest.fixture()
def pages(rows):
    data = [
        page("live", NOW + DAY),
        page("edge", NOW),
        page("old", NOW - DAY),
        page("dead", NOW + DAY, is_dead=True, http_status=404, raw_excerpt=None),
        page("empty", NOW + DAY, raw_excerpt="", digest=""),
        page("digested", NOW + DAY, digest="d", raw_excerpt=None),
    ]
    return rows(data, SCHEMAS["page_cache"])


def test_expiry_is_strict(pages):
    assert {r.url_key for r in cache.live(pages, AS_OF).collect()} == {"live", "dead", "empty", "digested"}


def test_ttl_filter_reaches_the_scan(spark, pages, tmp_path):
    path = str(tmp_path / "cache")
    pages.write.parquet(path)
    plan = cache.live(spark.read.schema(SCHEMAS["page_cache"]).parquet(path), AS_OF).select("url_key")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(expires_at" in text
    assert "raw_excerpt" not in text


def test_probe(rows, pages):
    req = rows([(k,) for k in ("live", "edge", "dead", "empty", "none")], "url_key string")
    got = {r.url_key: (r.probe, r.cached_has_body) for r in cache.probe_pages(req, pages, AS_OF).collect()}
    assert got == {
        "live": ("live", True),
        "edge": ("miss", None),
        "dead": ("dead", False),
        "empty": ("live", False),
        "none": ("miss", None),
    }
    left = {r.url_key for r in cache.misses(req, pages, AS_OF).collect()}
    assert left == {"edge", "none"}


def test_empty_search_is_a_hit(rows):
    stored = rows(
        [("q1", [], True, NOW + DAY), ("q2", [], True, NOW)],
        "query_key string, result_urls array<string>, empty boolean, expires_at timestamp_ntz",
    )
    req = rows([("q1",), ("q2",), ("q3",)], "query_key string")
    got = {r.query_key: r.hit for r in cache.probe_search(req, stored, AS_OF).collect()}
    assert got == {"q1": True, "q2": False, "q3": False}


def test_upsert(rows, pages):
    new = rows(
        [
            ("old", "other-url", 200, False, "jina", None, "new body", 1),
            ("old", "other-url", 410, True, "native", None, None, 2),
            ("fresh", "f", 200, False, "tavily", None, "x", 1),
        ],
        "url_key string, url string, http_status int, is_dead boolean, provider string, digest string, raw_excerpt string, seq int",
    )
    newest = cache.latest(new, "url_key", "seq").drop("seq")
    writes = cache.page_writes(newest, AS_OF)
    after = cache.upsert_pages(pages, writes)
    got = {r.url_key: r for r in after.collect()}
    assert len(got) == 7
    old = got["old"]
    assert (old.url, old.fetch_count, old.http_status, old.is_dead, old.raw_excerpt) == ("u-old", 3, 410, True, None)
    assert old.expires_at == NOW + 90 * DAY and old.fetched_at == NOW
    assert got["fresh"].fetch_count == 1 and got["fresh"].expires_at == NOW + 30 * DAY
    assert got["live"].raw_excerpt == "body"
    again = cache.upsert_pages(after, writes)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, after.collect()), key=repr)


def test_bump_counts_live_hits_only(rows, pages):
    req = rows([("live",)] * 50 + [("old",)] * 5 + [("none",)], "url_key string")
    got = {r.url_key: r.fetch_count for r in cache.bump(pages, req, AS_OF).collect()}
    assert got["live"] == 53 and got["old"] == 3 and got["edge"] == 3


def test_changed(rows):
    a = rows([("k1", "x"), ("k2", "x"), ("k3", None), ("k4", "x")], "url_key string, content_hash string")
    b = rows([("k1", "x"), ("k2", "y"), ("k3", "x"), ("k5", "x")], "url_key string, content_hash string")
    assert {r.url_key for r in cache.changed(a, b).collect()} == {"k2", "k3"}


def test_bucketed_cache_is_probed_without_a_shuffle(spark, rows, pages, tmp_path):
    from enrichspark.sources.sinks import save_bucketed

    req = rows([("https://a.com/",), ("https://b.com/",)], "url string").select(url_key_col())
    save_bucketed(pages, "bucketed_pages", "url_key", 4, str(tmp_path / "pages"))
    save_bucketed(req, "bucketed_requests", "url_key", 4, str(tmp_path / "requests"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probed = cache.probe_pages(spark.table("bucketed_requests"), spark.table("bucketed_pages"), AS_OF)
        plan = probed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table bucketed_pages")
        spark.sql("drop table bucketed_requests")


def url_key_col():
    from pyspark.sql import functions as F

    return url_key(F.col("url")).alias("url_key")
