"""Stored forms: bucketed pages, text files of bounded size, sketches, use counts, domain lists, names in SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from enrichspark.functions import keys
from enrichspark.functions.keys import with_query_key, with_url_key
from enrichspark.functions.payloads import RESULT_TYPE
from enrichspark.operators import cache, facts, resolve
from enrichspark.sources import files, sinks
from enrichspark.sources.derived import Derived
from enrichspark.sources.tables import SCHEMAS

from conftest import SF

AS_OF = "2024-02-01 00:00:00"
LONG = "word " * 200


def test_page_text_stays_where_it_is(spark):
    d = Derived(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = d.claim.select("claim_id", "quote", "source_url")
        checked = facts.verify_claims(claims, d.stored_page)
        plan = checked._jdf.queryExecution().executedPlan()
        # a pattern in the plan may hold line ends of its own
        lines = [x for x in plan.toString().split("\n") if re.match("[ :]*[+:]- ", x)]
        assert any("SortMergeJoin" in x for x in lines)
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "content" in x and "Bucketed: true" in x)
        indent = [len(x) - len(x.lstrip(" +-:")) for x in lines]
        way, depth = [], indent[scan]
        for i in range(scan, -1, -1):  # what stands above the scan, up to the join
            if indent[i] < depth:
                way, depth = [*way, lines[i]], indent[i]
        join = next(i for i, x in enumerate(way) if "SortMergeJoin" in x)
        assert not any("Exchange" in x for x in way[:join])
        assert {tuple(r) for r in checked.select("claim_id", "verified").collect()} == {
            tuple(r) for r in facts.verify_claims(claims, d.page.select("url_key", "content")).select("claim_id", "verified").collect()
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("slice_rows", [1_000_000, 60])
def test_text_files_are_bounded_in_bytes(spark, rows, tmp_path, slice_rows):
    rng = random.Random(slice_rows)
    texts = [(i, "é" * rng.choice([0, 1, 20, 50, 400])) for i in range(400)] + [(400, "x" * 5000), (401, None)]
    sinks.write_texts(rows(texts, "doc_id long, text string").repartition(5), str(tmp_path / "t"), file_bytes=2000, slice_rows=slice_rows)
    got = files.read_files(spark, str(tmp_path / "t"), "*.txt")
    sizes = [r.n for r in got.select(F.octet_length("content").alias("n")).collect()]
    total = sum(len((t or "").encode()) + 1 for _, t in texts)
    assert sum(sizes) == total and sorted(sizes)[-2] <= 2000 and sorted(sizes)[-1] == 5001
    assert len(sizes) < 4 * total / 2000 + 10
    lines = sorted(line for r in got.collect() for line in r.content[:-1].split("\n"))
    assert lines == sorted((t or "") for _, t in texts)


def test_sketches_count_hosts_over_days(rows):
    rng = random.Random(6)
    sizes = {"one": 1, "two": 2, "few": 30, "many": 20000}
    data = []
    for value, n in sizes.items():
        hosts = list(range(n)) + [rng.randrange(n) for _ in range(n)]
        data += [("e", "f", value, f"https://h{h}.com/{i}", True, i % 5) for i, h in enumerate(hosts)]
    data += [("e", "f", "one", "https://x.com/", False, 1), ("e", "f", "one", None, True, 1)]
    frame = rows(data, "entity_name string, field string, value string, source_url string, verified boolean, day int")
    sketches = facts.source_sketches(frame)
    assert sketches.groupBy("day", "value").count().where("count > 1").count() == 0
    got = {r.value: r.sources for r in facts.two_sources_of_sketches(sketches).collect()}
    exact = {r.value: r.sources for r in facts.two_sources(frame).collect()}
    assert set(got) == set(exact) == {"two", "few", "many"} and got["two"] == 2 and got["few"] == 30
    assert abs(got["many"] / exact["many"] - 1) < 4 * 0.0163  # four standard errors


def test_use_counts_equal_a_walk(rows):
    """Requests one after the other against a cache that is written and counted as they go."""
    rng = random.Random(12)
    urls = [f"https://h.com/{i}" for i in range(30)]
    body = {u: rng.choice([(True, 200, LONG), (False, 404, ""), (False, 500, ""), (True, 200, "thin")]) for u in urls}
    stored = {u: rng.choice(["2024-03-01", "2024-01-01"]) for u in urls if rng.random() < 0.5}
    counts = {u: i + 1 for i, u in enumerate(stored)}
    before = dict(counts)
    asked = [(i, rng.choice(urls)) for i in range(300)] + [(300, "no/web/address")]
    live = {u for u, until in stored.items() if until > "2024-02"}
    for _, url in asked:
        if url in live:
            counts[url] += 1
        elif url in body:
            ok, status, text = body[url]
            if status == 404 or (ok and len(text) >= 500):
                live.add(url)
                counts.setdefault(url, 1)
    page = rows([(u, 200, False, "native", None, "old", f"{t} 00:00:00", before[u]) for u, t in stored.items()],
                "url string, http_status int, is_dead boolean, provider string, digest string, raw_excerpt string, expires string, fetch_count long")
    page = with_url_key(page).withColumns({"content_hash": F.lit("x"), "fetched_at": F.lit("2023-12-01").cast("timestamp_ntz"), "expires_at": F.col("expires").cast("timestamp_ntz")})
    page = page.select(*cache.PAGE_COLUMNS)
    out = with_url_key(rows([(u, "native", *v) for u, v in body.items()], "url string, rung string, ok boolean, status int, content string")).withColumn("latency_ms", F.lit(1))
    requests = rows([(i, "r", "e", u) for i, u in asked], "req long, run_id string, entity_name string, url string")
    done = resolve.resolve_fetch(requests, out, page, AS_OF)
    after = cache.upsert_pages(page, done.writes, uses=done.uses)
    names = {r.url_key: r.url for r in with_url_key(rows([(u,) for u in urls], "url string")).collect()}
    assert {names[r.url_key]: r.fetch_count for r in after.collect()} == counts and after.columns == page.columns


def test_paid_results_lie_within_the_asked_domains(rows):
    urls = ["https://a.com/1", "https://x.A.com/2", "https://b.org/3", "https://y.b.org/4", "https://nota.com/5", "bad url"]
    hits = [(f"t{i}", u, "c") for i, u in enumerate(urls)]
    out = with_query_key(rows([("q", "tavily", hits), ("q", "keyword", []), ("p", "tavily", hits), ("p", "keyword", hits)], f"query string, rung string, results {RESULT_TYPE}"))
    out = out.drop("query").withColumn("latency_ms", F.lit(1))
    lists = rows(
        [("in", "a.com", False), ("in", "a.com", None), ("out", "B.org", True), ("both", "b.org", False), ("both", "y.b.org", True), ("none", "c.net", False)]
        + [("long", f"d{i}.net", False) for i in range(500)] + [("long", "org", False)],
        "domain_list string, domain string, excluded boolean",
    )
    want = {"in": [0, 1], "out": [0, 1, 4, 5], "both": [2], "none": [], "long": [2, 3], None: [0, 1, 2, 3, 4, 5], "unknown": [0, 1, 2, 3, 4, 5]}
    cached = rows([], SCHEMAS["search_cache"]) if "search_cache" in SCHEMAS else None
    for name, places in want.items():
        asked = [(1, "r", "e", "q", name), (2, "r", "e", "q", "none"), (3, "r", "e", "p", name)]
        requests = rows(asked, "req long, run_id string, entity_name string, query string, domain_list string")
        done = resolve.resolve_search(requests, out, cached, AS_OF, domains=lists)
        got = {r.req: r for r in resolve.with_results(done.resolved, out, cached, domains=lists).collect()}
        assert [urls.index(x.url) for x in got[1].results] == places, name
        assert got[1].ok == bool(places) and got[1].credits == int(bool(places))
        # the cache does not know of lists: what the first one stored is what later ones get
        assert got[2].from_cache and [x.url for x in got[2].results] == [x.url for x in got[1].results]
        assert len(got[3].results) == 6 and got[3].provider == "keyword"
        kept = {len(r.result_urls): r.empty for r in done.writes.collect()}
        assert kept.get(len(places)) == (not places)


def test_jobs_in_one_session_keep_their_companies_apart(spark, rows):
    names = []
    for who in ("first", "second"):
        names.append(keys.register_domain_check(spark, rows([(f"{who}.com", "customer", who, None)], "domain_normalized string, status string, company_name string, notes string")))
    for who, name in zip(("first", "second"), names):
        got = spark.sql(f"SELECT * FROM {name}(array('https://www.first.com/x', 'second.com', NULL, ''))").collect()
        assert {r.input_domain: r.company_name for r in got if r.company_name} == {{"first": "https://www.first.com/x", "second": "second.com"}[who]: who}
        assert [r.status for r in got if r.company_name is None] == ["net-new"] * 3


def test_rows_without_domain_are_spread(spark, rows):
    known = rows([("a.com", "customer", "A", None)], "domain_normalized string, status string, company_name string, notes string")
    asked = spark.range(3000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, F.lit("a.com")).alias("domain"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name = keys.register_domain_check(spark, known)
        got = spark.sql(f"SELECT e.pos, c.*, spark_partition_id() AS p FROM {{e}} e, LATERAL {name}(array(e.domain), e.pos) c", e=asked)
        lost = got.where("input_domain is null").groupBy("p").count().collect()
        assert sum(r["count"] for r in lost) == 1000 and got.count() == 3000
        assert got.where("company_name = 'A'").count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
