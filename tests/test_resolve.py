"""Resolution against a plain request-by-request walk."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from enrichspark.functions.keys import query_key, url_key, with_url_key
from enrichspark.functions.payloads import RESULT_TYPE
from enrichspark.functions.policy import DEFAULT_POLICY, Rung
from enrichspark.operators import resolve
from enrichspark.sources.tables import SCHEMAS

AS_OF = "2024-02-01 00:00:00"
LONG = "word " * 200
BODIES = ["", "   ", "thin", LONG, "captcha " + LONG[:900], "x" * 300]
ORDER = ["native", "jina", "tavily", "parallel"]
NEED = {"jina": 500, "parallel": 200}


def make_fetches(seed, n_urls=25, n_req=400):
    rng = random.Random(seed)
    outcomes = {}
    for u in range(n_urls):
        for rung in ORDER:
            if rng.random() < 0.9:
                ok = rng.random() < 0.5
                status = 200 if ok else rng.choice([404, 403, 500, 401, 410])
                outcomes[(u, rung)] = (ok, status, rng.choice(BODIES) if ok or rng.random() < 0.3 else "", rng.randrange(90))
    # A third of all requests ask for one page.
    reqs = [
        (i, 0 if rng.random() < 0.34 else rng.randrange(n_urls), rng.random() < 0.3, rng.random() < 0.3)
        for i in range(n_req)
    ]
    rng.shuffle(reqs)
    cached = {u: rng.choice([("alive", "kept body"), ("alive", ""), ("dead", None)]) for u in range(n_urls) if rng.random() < 0.2}
    return outcomes, reqs, cached


def usable(body):
    """Of the bodies above only the long plain one."""
    return body == LONG


def walk(outcomes, reqs, cached, configured):
    """One request after the other, the cache growing as they go."""
    store = {u: (kind, body, 404 if kind == "dead" else 200) for u, (kind, body) in cached.items()}
    result, events = {}, []
    for req, u, allow, cooling in sorted(reqs):
        if u in store:
            kind, body, status = store[u]
            events.append((req, "cache", True, 0, 0.0))
            dead = kind == "dead"
            result[req] = ("dead" if dead else "cache", not dead and bool(body), True, status)
            continue
        tier = None
        thin = ""
        for rung in ORDER:
            ok, status, body, _ = outcomes.get((u, rung), (False, None, "", None))
            if rung == "parallel" and (not allow or "parallel" not in configured):
                continue
            able = rung != "tavily" or ("tavily" in configured and not cooling)
            if rung == "native":
                won, thin = ok and usable(body), body.strip()
            elif rung == "tavily":
                won = able and ok and bool(body)
            else:
                won = ok and len(body.strip()) >= NEED[rung]
            events.append((req, rung, won, int(won and rung == "tavily"), 0.005 if won and rung == "parallel" else 0.0))
            if won:
                tier, final = rung, status if rung == "native" else 200
                store[u] = ("alive", body[:4000], final)
                break
            if rung == "native" and status in (401, 404, 410):
                tier, final = "dead", status
                store[u] = ("dead", None, status)
                break
        if tier is None:
            tier, final = ("native-thin", None) if thin else ("failed", None)
        result[req] = (tier, tier not in ("dead", "failed"), False, final)
    return result, events, store


def fetch_tables(rows, outcomes, reqs, cached):
    url = "https://h.com/{}".format
    requests = rows([(i, 1, "e", url(u), a, c) for i, u, a, c in reqs], "req long, run_id int, entity_name string, url string, allow_parallel boolean, cooling boolean")
    got = rows(
        [(url(u), rung, *v) for (u, rung), v in outcomes.items()],
        "url string, rung string, ok boolean, status int, content string, latency_ms int",
    ).withColumn("url_key", url_key(F.col("url"))).drop("url")
    stored = rows(
        [(url(u), kind == "dead", 404 if kind == "dead" else 200, body) for u, (kind, body) in cached.items()],
        "url string, is_dead boolean, http_status int, raw_excerpt string",
    ).select(
        url_key(F.col("url")).alias("url_key"),
        "url",
        "http_status",
        "is_dead",
        "raw_excerpt",
        F.lit(None).cast("string").alias("digest"),
        F.lit("2024-02-02 00:00:00").cast("timestamp_ntz").alias("expires_at"),
    )
    return requests, got, stored


@pytest.mark.parametrize(("seed", "configured"), [(1, ("tavily", "parallel")), (2, ("parallel",)), (3, ("tavily",)), (4, ())])
def test_fetch_equals_the_walk(rows, seed, configured):
    outcomes, reqs, cached = make_fetches(seed)
    want, events, store = walk(outcomes, reqs, cached, configured)
    tables = fetch_tables(rows, outcomes, reqs, cached)
    got = resolve.resolve_fetch(*tables, AS_OF, configured=configured)
    assert {r.req: (r.tier, r.ok, r.from_cache, r.status) for r in got.resolved.collect()} == want
    seen = [(r.req, r.rung, r.success, r.cost_credits, float(r.cost_usd)) for r in got.events.collect()]
    assert sorted(seen) == sorted(events)
    writes = {r.url.rsplit("/", 1)[1]: (r.is_dead, r.raw_excerpt, r.http_status) for r in got.writes.collect()}
    fresh = {str(u): (k == "dead", b, s) for u, (k, b, s) in store.items() if u not in cached}
    assert writes == fresh


def test_content(rows):
    outcomes, reqs, cached = make_fetches(7)
    want, _, store = walk(outcomes, reqs, cached, ("tavily", "parallel"))
    requests, got, stored = fetch_tables(rows, outcomes, reqs, cached)
    resolved = resolve.resolve_fetch(requests, got, stored, AS_OF).resolved
    urls = {i: u for i, u, *_ in reqs}
    for r in resolve.with_content(resolved, got, stored).collect():
        u, tier = urls[r.req], want[r.req][0]
        if tier == "cache":
            assert r.content == store[u][1]
        elif tier in ("dead", "failed"):
            assert r.content == ""
        else:
            assert r.content == outcomes[(u, "native" if tier == "native-thin" else tier)][2]


def test_policy_order_is_data(rows):
    """With the paid rung moved up and always on, it wins wherever it can."""
    outcomes, reqs, cached = make_fetches(9)
    policy = (Rung("fetch", 1, "tavily", "credit", "always", credits=1), Rung("fetch", 2, "native", "free", "always"))
    got = resolve.resolve_fetch(*fetch_tables(rows, outcomes, reqs, {}), AS_OF, policy)
    urls = {i: u for i, u, *_ in reqs}
    cooling = {i: c for i, _, _, c in reqs}
    for r in got.resolved.where("not from_cache").collect():
        ok, _, body, _ = outcomes.get((urls[r.req], "tavily"), (False, None, "", None))
        if ok and body and not cooling[r.req]:
            assert r.tier == "tavily"
        else:
            assert r.tier != "tavily"


def test_native_runs_whatever_its_predicate(rows):
    outcomes, reqs, _ = make_fetches(9)
    policy = (Rung("fetch", 1, "native", "free", "no such test"),)
    got = resolve.resolve_fetch(*fetch_tables(rows, outcomes, reqs, {}), AS_OF, policy)
    assert got.events.where("rung = 'native'").count() > 0


def test_targets_that_are_no_web_address(rows):
    outcomes, reqs, cached = make_fetches(5)
    requests, got, stored = fetch_tables(rows, outcomes, reqs[:20], cached)
    extra = rows(
        [(9001, "notes/a.txt"), (9002, "nowhere.txt"), (9003, "acme.com/x"), (9004, None), (9005, "HTTPS://h.com/1"), (9006, " https://h.com/1")],
        "req long, url string",
    ).selectExpr("req", "1 as run_id", "'e' as entity_name", "url", "true as allow_parallel", "false as cooling")
    files = rows([("notes/a.txt", "kept here"), ("https://h.com/1", "never used")], "source string, content string")
    done = resolve.resolve_fetch(requests.unionByName(extra), got, stored, AS_OF, files=files)
    shown = resolve.with_content(done.resolved, got, stored, files)
    mine = {r.req: (r.tier, r.ok, r.content, r.error) for r in shown.where("req > 9000").collect()}
    missing = ("missing", False, "", "not a URL and not a file")
    assert mine == {9001: ("file", True, "kept here", None), 9002: missing, 9003: missing, 9004: missing, 9005: missing, 9006: missing}
    assert shown.count() == 26
    assert done.events.where("req > 9000").count() == 0
    assert done.writes.where("url not like 'https://h.com/%'").count() == 0


def search_walk(outcomes, reqs, cached, configured):
    store, result, events = dict(cached), {}, []
    for req, qn, intent, allow in sorted(reqs):
        if qn in store:
            events.append((req, "cache", True, 0))
            result[req] = ("cache", bool(store[qn]), True)
            continue
        found, winner = [], "none"
        for rung in ("keyword", "exa", "tavily", "parallel"):
            if rung == "exa" and (intent != "semantic" or "exa" not in configured):
                continue
            if rung == "parallel" and (not allow or "parallel" not in configured):
                continue
            found = outcomes.get((qn, rung), []) if rung in ("keyword", *configured) else []
            events.append((req, rung, bool(found), int(bool(found) and rung == "tavily")))
            if found:
                winner = rung
                break
        store[qn] = found
        result[req] = (winner, bool(found), False)
    return result, events, store


@pytest.mark.parametrize(("seed", "configured"), [(1, ("exa", "tavily", "parallel")), (2, ("parallel",)), (3, ("tavily",))])
def test_search_equals_the_walk(rows, seed, configured):
    rng = random.Random(seed)
    outcomes = {
        (qn, r): [("t", f"u{r}", "c")] * rng.randrange(0, 3)
        for qn in range(30)
        for r in ("keyword", "exa", "tavily", "parallel")
        if rng.random() < 0.8
    }
    reqs = [
        (i, 0 if rng.random() < 0.34 else rng.randrange(30), rng.choice(["semantic", "keyword"]), rng.random() < 0.5)
        for i in range(300)
    ]
    cached = {qn: rng.choice([[], [("t", "u", "c")]]) for qn in range(30) if rng.random() < 0.2}
    want, events, store = search_walk(outcomes, reqs, cached, configured)
    text = "Query  {}".format
    requests = rows([(i, 1, "e", text(q) + " " * (i % 3), n, a) for i, q, n, a in reqs], "req long, run_id int, entity_name string, query string, query_intent string, allow_parallel boolean")
    key = query_key(F.col("q")).alias("query_key")
    got = rows([(text(q), r, res, 5) for (q, r), res in outcomes.items()], f"q string, rung string, results {RESULT_TYPE}, latency_ms int")
    stored = rows([(text(q), res, not res) for q, res in cached.items()], f"q string, result_urls {RESULT_TYPE}, empty boolean")
    stored = stored.select(key, "result_urls", "empty", F.lit("2024-02-02 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    done = resolve.resolve_search(requests, got.select(key, "rung", "results", "latency_ms"), stored, AS_OF, configured=configured)
    assert {r.req: (r.provider, r.ok, r.from_cache) for r in done.resolved.collect()} == want
    assert sorted((r.req, r.rung, r.success, r.cost_credits) for r in done.events.collect()) == sorted(events)
    fresh = {text(q): len(res) for q, res in store.items() if q not in cached}
    assert {r.query.rstrip(): len(r.result_urls) for r in done.writes.collect()} == fresh
    shown = resolve.with_results(done.resolved, got.select(key, "rung", "results"), stored)
    by_req = {i: q for i, q, *_ in reqs}
    assert all(len(r.results) == len(store[by_req[r.req]]) for r in shown.collect())


def test_fetch_modes(rows):
    out = rows(
        [
            ("https://a.com/", "native", True, 200, LONG),
            ("https://b.com/", "native", False, 404, ""),
            ("https://c.com/", "native", True, 200, "thin"),
            ("https://c.com/", "tavily", True, 200, "paid"),
            ("https://d.com/", "native", True, 200, "thin"),
            ("https://d.com/", "tavily", False, 432, ""),
            ("https://e.com/", "native", False, 500, ""),
            ("https://e.com/", "tavily", False, 429, ""),
        ],
        "url string, rung string, ok boolean, status int, content string",
    ).select(url_key(F.col("url")).alias("url_key"), "rung", "ok", "status", "content", F.lit(1).alias("latency_ms"))
    req = rows([(f"https://{c}.com/",) for c in "abcde"], "url string")

    def run(**kw):
        return {r.url[8]: r for r in resolve.fetch_pages(req, out, **kw).collect()}

    cheap = run(mode="cheap", depth="advanced")
    assert [cheap[c].tier for c in "abcde"] == ["native", "dead", "tavily", "native-thin", "failed"]
    assert [cheap[c].credits for c in "abcde"] == [0, 0, 2, 0, 0]
    assert cheap["e"].error == "no usable content (Tavily credits exhausted)"
    assert cheap["b"].error.startswith("dead URL (HTTP 404)") and cheap["c"].error is None
    assert cheap["e"].credits_exhausted and cheap["e"].source == "tavily" and cheap["d"].ok
    offline = run(mode="cheap", available=False)
    assert [offline[c].tier for c in "abcde"] == ["native", "dead", "native-thin", "native-thin", "failed"]
    assert offline["e"].source == "native" and offline["e"].error == "HTTPError 500"
    paid = run(mode="tavily")
    assert [paid[c].source for c in "abcde"] == ["native", "native", "tavily", "native", "native"]
    bare = run(mode="tavily", fallback=False)
    assert bare["c"].ok and not bare["a"].ok and bare["a"].error == "not extracted (fallback off)"
    assert run(mode="tavily", fallback=False, available=False)["a"].source == "skipped"
    assert run(mode="fallback")["c"].source == "native"
    with pytest.raises(ValueError):
        run(mode="other")


def _walked_calls(requests, native, tavily, cheap):
    """One call after the other, batch by batch, as one who fetches them would."""
    calls, got = {}, {}
    for req, call, url in sorted(requests):
        calls.setdefault(call, []).append((req, url))
    for call, asked in calls.items():
        urls = [u for _, u in asked]
        if cheap:
            urls = [u for u in dict.fromkeys(urls) if native.get(u, (None, ""))[0] not in (200, 404)]
        bought, exhausted = set(), False
        for i in range(0, len(urls), 20):
            statuses = [tavily[u][0] for u in urls[i : i + 20] if u in tavily]
            if any(s in (429, 432, 433) for s in statuses):
                exhausted = True
                break
            if any(s not in (200, None) for s in statuses):
                break
            bought |= {u for u in urls[i : i + 20] if u in tavily and tavily[u][1]}
        for req, url in asked:
            free = cheap and native.get(url, (None, ""))[0] in (200, 404)
            got[req] = (url in bought and not free, exhausted and not free)
    return got


@pytest.mark.parametrize("slice_rows", [1_000_000, 37])
def test_a_refused_batch_ends_its_call(rows, slice_rows):
    rng = random.Random(slice_rows)
    urls = [f"https://h.com/{i}" for i in range(150)]
    native = {u: rng.choice([(200, "word " * 200), (404, ""), (500, ""), (500, "")]) for u in urls}
    tavily = {u: rng.choice([(200, "text")] * 9 + [(200, "")]) for u in urls}
    tavily |= {urls[7]: (429, ""), urls[8]: (401, ""), urls[9]: (None, ""), urls[10]: (500, "")}
    native |= {u: (500, "") for u in urls[7:11]}
    asked, req = [], 0
    for call in ["a", "b", None, *range(25)]:
        for _ in range(rng.choice([1, 19, 20, 21, 90, 200])):
            req += 1
            asked.append((req, str(call) if call is not None else None, rng.choice(urls)))
    rng.shuffle(asked)
    outcomes = [(u, r, t != "", s, t) for r, of in (("native", native), ("tavily", tavily)) for u, (s, t) in of.items()]
    out = with_url_key(rows(outcomes, "url string, rung string, ok boolean, status int, content string"))
    out = out.withColumn("latency_ms", F.lit(1))
    requests = rows(asked, "req long, batch string, url string")
    seen = set()
    for mode in ("cheap", "tavily"):
        got = resolve.fetch_pages(requests, out, mode=mode, call=["batch"], slice_rows=slice_rows).collect()
        want = _walked_calls([(q, c, u) for q, c, u in asked], native, tavily, mode == "cheap")
        for r in got:
            bought, exhausted = want[r.req]
            assert (r.source == "tavily" and r.ok) == bought
            # a thin page or one the plain fetch settled is not a paid one
            assert r.credits_exhausted == exhausted
            seen.add((mode, bought, exhausted))
        assert len(got) == len(asked)
    assert len(seen) == 8  # also pages bought before the limit came


def test_keyword_rung_is_filled_by_the_engines_in_order(rows):
    one, two = [("t1", "https://a.com", "c")], [("t2", "https://b.com", "c")]
    data = [("q1", "ddg", [], 5), ("q1", "brave", two, 7), ("q1", "serper", one, 9), ("q2", "ddg", one, 3), ("q3", "ddg", [], 4), ("q3", "serper", [], 6)]
    given = rows(data, f"query_key string, rung string, results {RESULT_TYPE}, latency_ms long")

    def run(**kw):
        return {r.query_key: (r.rung, r.engine, [x.title for x in r.results], r.latency_ms) for r in resolve.keyword_answers(given, **kw).collect()}

    assert run() == {"q1": ("keyword", "brave", ["t2"], 12), "q2": ("keyword", "ddg", ["t1"], 3), "q3": ("keyword", None, [], 10)}
    assert run(resting=["brave"])["q1"] == ("keyword", "serper", ["t1"], 14)
    outcomes = rows([("q1", "keyword", one, 1, "old"), ("q1", "exa", two, 2, None)], f"query_key string, rung string, results {RESULT_TYPE}, latency_ms long, engine string")
    full = resolve.with_keyword_engines(outcomes, resolve.keyword_answers(given))
    assert {(r.query_key, r.rung, r.engine) for r in full.collect()} == {("q1", "exa", None), ("q1", "keyword", "brave"), ("q2", "keyword", "ddg"), ("q3", "keyword", None)}


def test_engines(rows):
    some = [("t", "u", "c")]
    out = rows(
        [("q1", "ddg", []), ("q1", "serper", some), ("q2", "brave", some), ("q2", "ddg", some), ("q3", "ddg", [])],
        f"query_key string, rung string, results {RESULT_TYPE}",
    ).withColumn("latency_ms", F.lit(1))

    def run(**kw):
        return {
            r.query_key: (r.provider, [(a.provider, a.ok) for a in r.attempts])
            for r in resolve.resolve_engines(out, **kw).collect()
        }

    got = run()
    assert got["q1"] == ("serper", [("ddg", False), ("brave", False), ("claude_cli", False), ("serper", True)])
    assert got["q2"] == ("ddg", [("ddg", True)])
    assert got["q3"][0] == "none"
    assert run(configured=["serper"])["q1"][1] == [("ddg", False), ("serper", True)]
    assert run(resting=["ddg"])["q2"] == ("brave", [("brave", True)])


def test_resolver_asks_for_pending_only(spark, rows, tmp_path):
    """A provider plug-in sees what earlier rungs left, and is asked once per row."""
    log = str(tmp_path)

    def provider(name, good):
        def run(chunks):
            for pdf in chunks:
                with open(f"{log}/{name}", "a") as fh:
                    fh.writelines(f"{k}\n" for k in pdf["url_key"])
                yield pd.DataFrame({"url_key": pdf["url_key"], "ok": [good(int(k)) for k in pdf["url_key"]]})

        return run

    req = rows([(str(i),) for i in range(40)], "url_key string")
    answers = resolve.collect_outcomes(
        req,
        {"native": provider("native", lambda k: k % 2 == 0), "jina": provider("jina", lambda k: k % 3 == 0)},
        "url_key",
        "url_key string, ok boolean",
        lambda got: got.where("ok"),
    )
    assert answers.count() == answers.count() == 60
    assert len(open(f"{log}/native").read().split()) == 40
    assert sorted(map(int, open(f"{log}/jina").read().split())) == list(range(1, 40, 2))


def test_digest(rows):
    page = "x" * 9000
    fetched = rows(
        [(1, "k1", page, False), (2, "k2", page, False), (3, "k1", page, True), (4, "k1", "short", False), (5, "k3", page, False), (6, "k1", "old", True)],
        "req long, url_key string, content string, from_cache boolean",
    ).selectExpr("*", "case when req = 6 then null else 'jina' end as content_rung", "1 as run_id", "'e' as entity_name", "'u' as url", "'jina' as tier", "200 as status")
    digests = rows([("k1", "facts"), ("k3", "")], "url_key string, digest string")
    done = resolve.apply_digest(fetched, digests)
    got = {r.req: r for r in done.collect()}
    assert got[1].digested and got[1].content == "facts" and got[1].chars_in == 9000
    assert not got[2].digested and got[2].content.startswith("x" * 8000 + "\n\n[...truncated")
    # Whoever follows within the job is served the digest; an older cache entry and a short page stay.
    assert got[3].content == "facts" and not got[3].digested and got[6].content == "old"
    assert got[4].content == "short" and got[5].content.startswith("x" * 8000 + "\n\n")
    plain = resolve.apply_digest(fetched, digests, no_digest=True).collect()
    assert all(r.content in (page, "short", "old") and not r.digested for r in plain)
    write = resolve.digest_writes(done, AS_OF).collect()
    assert [(w.url_key, w.digest, w.raw_excerpt, w.provider) for w in write] == [("k1", "facts", None, "jina")]
    event = resolve.digest_events(done, AS_OF).collect()
    assert [(e.req, e.rung, e.tier) for e in event] == [(1, "digest", "cheap_model")]


def test_domain_filter(rows):
    df = rows([("acme.com",), ("www.acme.com",), ("notacme.com",), ("b.org",), (None,)], "h string")
    keep = lambda **kw: {r.h for r in resolve.filter_domains(df, F.col("h"), **kw).collect()}
    assert keep(include=["acme.com"]) == {"acme.com", "www.acme.com"}
    assert keep(exclude=["acme.com"]) == {"notacme.com", "b.org", None}
    assert keep(include=["acme.com", "b.org"], exclude=["www.acme.com"]) == {"acme.com", "b.org"}


def test_first_success_and_context(rows):
    df = rows(
        [(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False), (2, 2, False)],
        "req long, ordinal int, ok boolean",
    )
    won = {r.req: r.winner for r in resolve.first_success(df, "req").collect()}
    assert won == {1: 2, 2: None}
    ctx = {(r.req, r.ordinal): (r.prev_rungs_empty, r.prev_rung_failed) for r in resolve.with_ctx(df).collect()}
    assert ctx[(1, 1)] == (True, False) and ctx[(1, 2)] == (True, True) and ctx[(1, 3)] == (False, True)


def test_schemas_cover_the_tables():
    assert {"page_cache", "search_cache", "run", "entity_telemetry", "rung_event", "known_companies"} == set(SCHEMAS)
    assert len(DEFAULT_POLICY) == 8


def test_a_rung_that_cannot_run_has_no_latency(rows):
    out = rows(
        [("https://a.com/", "native", False, 500, "", 3), ("https://a.com/", "tavily", True, 200, LONG, 13)],
        "url string, rung string, ok boolean, status int, content string, latency_ms int",
    )
    out = out.select(url_key(F.col("url")).alias("url_key"), *out.columns[1:])
    cached = rows([], SCHEMAS["page_cache"])
    for cooling, want in ((True, [("native", False, 3), ("tavily", False, None)]), (False, [("native", False, 3), ("tavily", True, 13)])):
        req = rows([(1, 1, "e", "https://a.com/", False, cooling)], "req long, run_id long, entity_name string, url string, allow_parallel boolean, cooling boolean")
        events = resolve.resolve_fetch(req, out, cached, AS_OF).events.where("rung in ('native', 'tavily')")
        assert sorted((e.rung, e.success, e.latency_ms) for e in events.collect()) == want


def test_search_names_the_engine_and_keeps_n_results(rows):
    results = [("t", f"u{i}", "c") for i in range(9)]
    out = rows([("q", "keyword", results, 1, "brave")], f"q string, rung string, results {RESULT_TYPE}, latency_ms int, engine string")
    out = out.select(query_key(F.col("q")).alias("query_key"), "rung", "results", "latency_ms", "engine")
    req = rows([(1, 1, "e", "q"), (2, 1, "e", " Q "), (3, 1, "e", "other")], "req long, run_id long, entity_name string, query string")
    done = resolve.resolve_search(req, out, rows([], SCHEMAS["search_cache"]), AS_OF)
    assert [(r.req, r.provider) for r in done.resolved.orderBy("req").collect()] == [(1, "brave"), (2, "cache"), (3, "none")]
    shown = resolve.with_results(done.resolved, out, rows([], SCHEMAS["search_cache"])).orderBy("req").collect()
    assert [len(r.results) for r in shown] == [6, 6, 0]
    writes = {r.query: len(r.result_urls) for r in done.writes.collect()}
    assert writes == {"q": 6, "other": 0}
