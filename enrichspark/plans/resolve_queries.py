"""Searches and page fetches resolved end to end over whole request tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.keys import register_domain_check, register_sql_functions, with_url_key
from enrichspark.operators import cache, facts, resolve
from enrichspark.operators.ordered import top_one
from enrichspark.plans import oracle as q
from enrichspark.plans.enrich import Enrichment
from enrichspark.plans.registry import query
from enrichspark.plans.table_queries import fetched_content
from enrichspark.sources.derived import AS_OF, Derived

NOW = q.NOW


def _search(d: Derived) -> resolve.Resolution:
    return resolve.resolve_search(d.search_request, d.search_outcome, d.search_cache, AS_OF)


def _fetch(d: Derived) -> resolve.Resolution:
    return resolve.resolve_fetch(d.page_request, d.page_outcome, d.page_cache, AS_OF)


@query("resolve_search", "select * from search_resolved", "search_resolved")
def resolve_search(d: Derived) -> DataFrame:
    return _search(d).resolved


@query(
    "resolve_search_results",
    f"""ranked as (select r.req, case when s.hit then case when s.cached_empty then null else 'keyword' end else r.result_rung end as rung,
        case when s.hit then 8 else 6 end as most, s.cid, s.canon from search_resolved r join searched s using (req))
    select req, nth, rung || ' result ' || cast(nth as varchar) as title,
      'https://r' || cast(nth as varchar) || '.example.com/' || cast(cid as varchar) as url, canon as content
    from (select *, unnest(range(1, most + 1)) as nth from ranked where rung is not null)""",
    "search_resolved searched",
)
def resolve_search_results(d: Derived) -> DataFrame:
    """The result rows each request receives, fresh or cached."""
    rows = resolve.with_results(_search(d).resolved, d.search_outcome, d.search_cache)
    ranked = rows.select("req", F.posexplode("results").alias("i", "r"))
    return ranked.select("req", (F.col("i") + 1).cast("long").alias("nth"), "r.title", "r.url", "r.content")


_LISTED = """listed as (select *, case run_id % 4 when 1 then 'few' when 2 then 'most' when 3 then 'none' else '' end as domain_list,
      alone as free from search_alone),
  paid as (select * exclude (alone), case when free is distinct from 'tavily' or domain_list <> 'none' then free
      when allow_parallel and cid % 9 <> 0 then 'parallel' end as alone from listed),
  leads as (select query_key, min(req) as lead_req, arg_min_null(alone, req) as lead_rung, arg_min(domain_list, req) as lead_list
      from paid where not hit group by query_key),
  within as (select p.*, l.lead_rung, l.lead_list, not hit and coalesce(req > l.lead_req, false) as follows from paid p left join leads l using (query_key)),
  sources as (select *, case when hit then null when follows then lead_rung else alone end as rung,
      case when follows then lead_list else domain_list end as list from within)"""


def _domain_lists(d: Derived) -> DataFrame:
    """Two hosts; a domain less one of its hosts; a domain that nothing lies in."""
    rows = [("few", "R2.example.com", False), ("few", "r5.example.com", False), ("most", "example.com", False)]
    rows += [("most", "r1.example.com", True), ("none", "example.org", False)]
    return d.spark.createDataFrame(rows, "domain_list string, domain string, excluded boolean")


@query(
    "search_within_domains",
    _LISTED
    + """ select req, coalesce(rung, 'none') as rung, nth, 'https://r' || cast(nth as varchar) || '.example.com/' || cast(cid as varchar) as url,
      case when hit or follows then 0 when alone = 'tavily' then 1 else 0 end as credits
    from (select *, unnest(case when rung is distinct from 'tavily' or list = '' then range(1, 7)
        when list = 'few' then [2, 5] else range(2, 8) end) as nth from sources where rung is not null)""",
    "search_alone",
)
def search_within_domains(d: Derived) -> DataFrame:
    """Fresh search results where three runs of four ask the paid search for certain domains only."""
    run = F.col("run_id") % 4
    named = F.when(run == 1, "few").when(run == 2, "most").when(run == 3, "none")
    requests, domains = d.search_request.withColumn("domain_list", named), _domain_lists(d)
    got = resolve.resolve_search(requests, d.search_outcome, d.search_cache, AS_OF, domains=domains).resolved
    rows = resolve.with_results(got, d.search_outcome, d.search_cache, domains=domains).where("result_rung is not null")
    return rows.select("req", F.col("result_rung").alias("rung"), "credits", F.explode("results").alias("r")).select(
        "req",
        "rung",
        F.regexp_extract("r.url", r"//r(\d+)", 1).cast("long").alias("nth"),
        "r.url",
        F.col("credits").cast("int").alias("credits"),
    )


_SEARCH_EVENTS = """
  select req, 'cache' as rung, true as success, 0 as credits, 0.0 as usd from searched where from_cache
  union all select req, 'keyword', alone is not distinct from 'keyword', 0, 0.0 from searched where not from_cache
  union all select req, 'exa', alone is not distinct from 'exa', 0, 0.0 from searched
    where not from_cache and query_intent = 'semantic' and alone is distinct from 'keyword'
  union all select req, 'tavily', alone is not distinct from 'tavily', case when alone = 'tavily' then 1 else 0 end, 0.0 from searched
    where not from_cache and coalesce(alone, 'none') not in ('keyword', 'exa')
  union all select req, 'parallel', alone is not distinct from 'parallel', 0, case when alone = 'parallel' then 0.005 else 0.0 end from searched
    where not from_cache and allow_parallel and coalesce(alone, 'parallel') = 'parallel'"""


@query(
    "search_attempt_events",
    f"select req, rung, success, cast(credits as bigint) as credits, round(usd, 6) as usd from ({_SEARCH_EVENTS})",
    "searched",
)
def search_attempt_events(d: Derived) -> DataFrame:
    return _search(d).events.select(
        "req",
        "rung",
        "success",
        F.col("cost_credits").alias("credits"),
        F.round(F.col("cost_usd").cast("double"), 6).alias("usd"),
    )


@query("resolve_fetch", "select * from fetch_resolved", "fetch_resolved")
def resolve_fetch(d: Derived) -> DataFrame:
    return _fetch(d).resolved


@query("resolve_fetch_content", "select req, tier, content from fetch_content", "fetch_content")
def resolve_fetch_content(d: Derived) -> DataFrame:
    return fetched_content(d).select("req", "tier", "content")


@query(
    "attempt_events",
    "select req, rung, tier, success, from_cache, cast(latency_ms as bigint) as latency_ms, cast(cost_credits as bigint) as cost_credits, "
    "round(cost_usd, 6) as cost_usd from fetch_event",
    "fetch_event",
)
def attempt_events(d: Derived) -> DataFrame:
    usd = F.round(F.col("cost_usd").cast("double"), 6).alias("cost_usd")
    cols = ["req", "rung", "tier", "success", "from_cache", "latency_ms", "cost_credits"]
    return _fetch(d).events.select(*cols, usd)


@query(
    "upsert_page",
    "select url_key, url, http_status, is_dead, provider, digest, raw_excerpt, fetched_at, expires_at, fetch_count from page_cache_after",
    "page_cache_after",
)
def upsert_page(d: Derived) -> DataFrame:
    """The page cache after all fetches are written back."""
    return cache.upsert_pages(d.page_cache, _fetch(d).writes).drop("content_hash")


@query(
    "page_cache_after",
    """select c.url_key, c.url, c.http_status, c.is_dead, c.provider, c.fetched_at, c.expires_at,
      cast(c.fetch_count + coalesce(u.uses, 0) as bigint) as fetch_count
    from page_cache_after c left join (select url_key, count(*) as uses from fetch_resolved where from_cache group by 1) u using (url_key)""",
    "page_cache_after fetch_resolved",
)
def page_cache_after(d: Derived) -> DataFrame:
    """The page cache after a job, with what it served from the cache counted in."""
    fetched = _fetch(d)
    after = cache.upsert_pages(d.page_cache, fetched.writes, uses=fetched.uses)
    return after.select("url_key", "url", "http_status", "is_dead", "provider", "fetched_at", "expires_at", "fetch_count")


# The pages of one entity in one run are fetched in one call: paid batches of 20 in order, the first refused one ends it.
_CALL = ["run_id", "entity_name"]
_ENDS = """ends as (select run_id, entity_name, min(batch) filter (tavily_status <> 200) as stop, min(batch) filter (tavily_limited) as lim
    from asked group by run_id, entity_name)"""
_CHEAP = f"""flagged as (select r.*, f.* exclude (url_key), coalesce(native_ok, false) or coalesce(native_status in (401, 404, 410), false) as settled
    from keyed_request r left join page_flags f using (url_key)),
  firsts as (select run_id, entity_name, url, min(req) as req, bool_or(tavily_limited) as tavily_limited, max(tavily_status) as tavily_status
    from flagged where not settled group by run_id, entity_name, url),
  asked as (select *, (row_number() over (partition by run_id, entity_name order by req) - 1) // 20 as batch from firsts),
  {_ENDS},
  answers as (select a.run_id, a.entity_name, a.url, coalesce(a.batch < e.stop, true) as given, coalesce(e.stop = e.lim, false) as exhausted
    from asked a join ends e using (run_id, entity_name)),
  tiers as (select f.*, coalesce(a.exhausted, false) as exhausted, case when native_ok then 'native' when native_status in (401, 404, 410) then 'dead'
    when tavily_ok and a.given then 'tavily' when native_text then 'native-thin' else 'failed' end as tier
  from flagged f left join answers a using (run_id, entity_name, url))"""


@query(
    "resolve_fetch_cheap",
    _CHEAP
    + """ select req, tier, case when tier = 'native-thin' then native_answered else tier in ('native', 'tavily') end as ok,
      cast(case when tier = 'tavily' then 2 else 0 end as bigint) as credits,
      tier in ('tavily', 'failed') and exhausted as credits_exhausted,
      case when tier <> 'tavily' then native_status end as status,
      case tier when 'dead' then 'dead URL (HTTP ' || cast(native_status as varchar) || ') — re-search, do not retry'
        when 'native-thin' then 'thin native body; Tavily could not improve it'
        when 'failed' then 'no usable content' || case when exhausted then ' (Tavily credits exhausted)' else '' end end as error
    from tiers""",
    "keyed_request page_flags",
)
def resolve_fetch_cheap(d: Derived) -> DataFrame:
    """Calls that hit a limit buy nothing more, and all their paid rows say so."""
    got = resolve.fetch_pages(d.page_request, d.page_outcome, mode="cheap", depth="advanced", call=_CALL)
    return got.select("req", "tier", "ok", "credits", "credits_exhausted", "status", "error")


_PAID_FIRST = f"""asked as (select r.*, f.* exclude (url_key), (row_number() over (partition by run_id, entity_name order by req) - 1) // 20 as batch
    from keyed_request r left join page_flags f using (url_key)),
  {_ENDS},
  paid as (select a.*, coalesce(tavily_ok, false) and coalesce(min(a.batch) over (partition by run_id, entity_name, url) < e.stop, true) as bought, coalesce(e.stop = e.lim, false) as exhausted
    from asked a join ends e using (run_id, entity_name))"""


@query(
    "resolve_fetch_paidfirst",
    _PAID_FIRST
    + """ select req, case when bought then 'tavily' else 'native' end as source, bought or coalesce(native_answered, false) as ok,
      exhausted as credits_exhausted, case when bought then null else native_status end as status
    from paid""",
    "keyed_request page_flags",
)
def resolve_fetch_paidfirst(d: Derived) -> DataFrame:
    got = resolve.fetch_pages(d.page_request, d.page_outcome, mode="tavily", call=_CALL)
    return got.select("req", "source", "ok", "credits_exhausted", "status")


@query(
    "resolve_fetch_nofallback",
    _PAID_FIRST
    + """ select req, 'tavily' as source, bought as ok, exhausted as credits_exhausted,
      case when not bought then 'not extracted (fallback off)' end as error
    from paid""",
    "keyed_request page_flags",
)
def resolve_fetch_nofallback(d: Derived) -> DataFrame:
    got = resolve.fetch_pages(d.page_request, d.page_outcome, mode="tavily", fallback=False, call=_CALL)
    return got.select("req", "source", "ok", "credits_exhausted", "error")


@query(
    "resolve_fetch_native",
    """select r.req, 'native' as source, coalesce(native_answered, false) as ok, native_status as status
    from keyed_request r left join page_flags f using (url_key)""",
    "keyed_request page_flags",
)
def resolve_fetch_native(d: Derived) -> DataFrame:
    got = resolve.fetch_pages(d.page_request, d.page_outcome, mode="fallback")
    return got.select("req", "source", "ok", "status")


@query(
    "free_engine_order",
    """won as (select query_key, case when cid % 3 >= 2 then 1 when cid % 5 >= 2 then 3 when cid % 6 >= 2 then 4 end as w from search_key)
    select query_key, case w when 1 then 'ddg' when 3 then 'claude_cli' when 4 then 'serper' else 'none' end as provider,
      case w when 1 then 'ddg:true' when 3 then 'ddg:false,claude_cli:true' when 4 then 'ddg:false,claude_cli:false,serper:true'
        else 'ddg:false,claude_cli:false,serper:false' end as attempts from won""",
    "search_key",
)
def free_engine_order(d: Derived) -> DataFrame:
    """Engine two rests, so it is never asked."""
    rows = resolve.resolve_engines(d.engine_outcome, resting=["brave"])
    shown = F.transform("attempts", lambda a: F.concat(a["provider"], F.lit(":"), a["ok"].cast("string")))
    return rows.select("query_key", "provider", F.array_join(shown, ",").alias("attempts"))


@query(
    "resolve_search_engines",
    """engined as (select *, case when cid % 3 >= 2 then 'ddg' when cid % 5 >= 2 then 'claude_cli' when cid % 6 >= 2 then 'serper' end as engine from search_alone),
  decided as (select * exclude (alone), case when engine is not null then 'keyword' when query_intent = 'semantic' and cid % 3 <> 0 then 'exa'
      when cid % 4 >= 2 then 'tavily' when allow_parallel and cid % 9 <> 0 then 'parallel' end as alone from engined),
  leads as (select query_key, min(req) as lead_req, arg_min_null(alone, req) as lead_rung from decided where not hit group by query_key)
    select d.req, case when hit or coalesce(req > lead_req, false) then 'cache' when alone = 'keyword' then engine else coalesce(alone, 'none') end as provider,
      case when hit then not cached_empty when req > lead_req then lead_rung is not null else alone is not null end as ok,
      case when hit or coalesce(req > lead_req, false) then null when cid % 3 >= 2 then 1 when cid % 5 >= 2 then 4 else 8 end as keyword_ms
    from decided d left join leads using (query_key)""",
    "search_alone",
)
def resolve_search_engines(d: Derived) -> DataFrame:
    """Searches whose keyword rung asks the free engines in their order; engine two rests."""
    answers = resolve.keyword_answers(d.engine_outcome, resting=["brave"])
    outcomes = resolve.with_keyword_engines(d.search_outcome, answers)
    done = resolve.resolve_search(d.search_request, outcomes, d.search_cache, AS_OF)
    asked = done.events.where("rung = 'keyword'").select("req", F.col("latency_ms").alias("keyword_ms"))
    rows = done.resolved.select("req", "provider", "ok").join(asked, "req", "left")
    return rows.withColumn("keyword_ms", F.col("keyword_ms").cast("int"))


_QUOTES = """sentences as (select url_key, nth, sentence from (
    select url_key, unnest(range(1, len(s) + 1)) as nth, unnest(s) as sentence from (
      select url_key, list_filter(list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)),
        lambda x: trim(x)), lambda x: x <> ''), lambda x: contains(lower(x), 'the ')) as s from page))),
  digests as (select url_key, string_agg('article: ' || sentence, chr(10) order by nth) as digest from sentences group by 1)"""


@query(
    "digest_apply",
    _QUOTES
    + """ select f.req, not f.from_cache and length(f.content) > 8000 and coalesce(d.digest, '') <> '' as digested, length(f.content) as chars_in,
      case when f.from_cache and f.content_rung is not null and url_key in (select url_key from fetch_content join digests using (url_key)
          where not from_cache and length(content) > 8000 and coalesce(digest, '') <> '') then d.digest
        when f.from_cache or length(f.content) <= 8000 then f.content when coalesce(d.digest, '') <> '' then d.digest
        else substr(f.content, 1, 8000) || chr(10) || chr(10) || '[...truncated; digest unavailable...]' end as content
    from fetch_content f left join digests d using (url_key)""",
    "fetch_content page",
)
def digest_apply(d: Derived) -> DataFrame:
    """Long fresh pages become the sentences that hold a wanted word."""
    return _digested(d).select("req", "digested", "chars_in", "content")


def _digested(d: Derived) -> DataFrame:
    wants = d.page.select("url_key", F.lit("article").alias("field"), F.array(F.lit("the ")).alias("terms"))
    digests = facts.quotes_as_digest(facts.extract_quotes(d.page, wants).where("found"))
    return resolve.apply_digest(fetched_content(d), digests)


_DIGESTED = _QUOTES + """, digested as (select f.*, d.digest as got from fetch_content f join digests d using (url_key)
    where not f.from_cache and length(f.content) > 8000 and coalesce(d.digest, '') <> '')"""


@query(
    "digest_event",
    _DIGESTED + " select req, 'digest' as rung, 'cheap_model' as tier, true as success, round(0.002, 6) as cost_usd from digested",
    "fetch_content page",
)
def digest_event(d: Derived) -> DataFrame:
    """One paid event for each page a digest was made of."""
    events = resolve.digest_events(_digested(d), AS_OF)
    return events.select("req", "rung", "tier", "success", F.round(F.col("cost_usd").cast("double"), 6).alias("cost_usd"))


@query(
    "digest_upsert",
    _DIGESTED
    + """ select c.url_key, case when g.url_key is null then c.provider else g.tier end as provider,
      case when g.url_key is null then c.digest else g.got end as digest, case when g.url_key is null then c.raw_excerpt end as raw_excerpt
    from page_cache_after c left join (select url_key, arg_min(tier, req) as tier, min(got) as got from digested group by 1) g using (url_key)""",
    "fetch_content page page_cache_after",
)
def digest_upsert(d: Derived) -> DataFrame:
    """The page cache after a job whose long pages were digested: the digest stands, the excerpt is gone."""
    fetched = cache.upsert_pages(d.page_cache, _fetch(d).writes)
    after = cache.upsert_pages(fetched, resolve.digest_writes(_digested(d), AS_OF))
    return after.select("url_key", "provider", "digest", "raw_excerpt")


@query(
    "fetch_tier_report",
    "select waterfall, rung, tier, count(*) as attempts, count(*) filter (where success) as successes, "
    "cast(sum(cost_credits) as bigint) as credits, round(sum(cost_usd), 6) as usd from (select 'fetch' as waterfall, * from fetch_event) group by 1, 2, 3",
    "fetch_event",
)
def fetch_tier_report(d: Derived) -> DataFrame:
    """What a whole resolution cost, by rung."""
    events = _fetch(d).events
    return events.groupBy("waterfall", "rung", "tier").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("successes"),
        F.sum("cost_credits").alias("credits"),
        F.round(F.sum("cost_usd").cast("double"), 6).alias("usd"),
    )


@query(
    "sql_domain_function",
    f"select req, {q.canon_domain('url')} as canon_domain from page_request",
    "page_request",
)
def sql_domain_function(d: Derived) -> DataFrame:
    """The domain rule as a SQL function."""
    register_sql_functions(d.spark)
    return d.page_request.select("req", F.expr("normalize_company_domain(url)").alias("canon_domain"))


@query(
    "run_after_fetch",
    "counted as (select r.run_id, e.rung, e.success, e.from_cache from fetch_event e join page_request r using (req)) "
    "select run_id, count(*) as attempts, count(*) filter (where from_cache) as cache_hits, count(*) filter (where success) as successes "
    "from counted group by 1",
    "fetch_event page_request",
)
def run_after_fetch(d: Derived) -> DataFrame:
    return _fetch(d).events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("from_cache").alias("cache_hits"),
        F.count_if("success").alias("successes"),
    )


@query(
    "sql_check_domains",
    f"""select e.pos, e.domain as input_domain, coalesce(k.status, 'net-new') as status, k.company_name, k.notes
    from entity e left join (select * from known where domain_normalized is not null
      qualify row_number() over (partition by domain_normalized order by id) = 1) k on k.domain_normalized = {q.canon_domain('e.domain')}""",
    "entity known",
)
def sql_check_domains(d: Derived) -> DataFrame:
    """The batch lookup as a SQL table function, joined laterally to a table of domains. Spark
    turns it into a plain equi-join."""
    keyed = d.known.where(F.col("domain_normalized").isNotNull())
    check = register_domain_check(d.spark, top_one(keyed, ["domain_normalized"], [F.asc("id")]))
    return d.spark.sql(
        f"SELECT e.pos, c.* FROM {{entities}} e, LATERAL {check}(array(e.domain), e.pos) c", entities=d.entity
    )


def _offline(position: int):
    """A provider that answers where one digit of the key is low."""

    def answer(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks:
            yield pd.DataFrame({"url_key": rows["url_key"], "ok": rows["url_key"].str[position].isin(list("01234567"))})

    return answer


@query(
    "resolver_hook",
    """asked as (select distinct url_key, substr(url_key, 1, 1) < '8' as a, substr(url_key, 2, 1) < '8' as b from keyed_request)
    select url_key, 'native' as rung, a as ok from asked union all select url_key, 'jina', b from asked where not a
    union all select url_key, 'tavily', true from asked where not a and not b and substr(url_key, 3, 1) < '8'
    union all select url_key, 'tavily', false from asked where not a and not b and substr(url_key, 3, 1) >= '8'""",
    "keyed_request",
)
def resolver_hook(d: Derived) -> DataFrame:
    """Three plug-in providers, each asked for what the ones before it left."""
    pending = with_url_key(d.page_request).select("url_key").distinct()
    providers = {"native": _offline(0), "jina": _offline(1), "tavily": _offline(2)}
    return resolve.collect_outcomes(
        pending, providers, "url_key", "url_key string, ok boolean", lambda got: got.where("ok")
    )


def _first_line(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in chunks:
        yield pd.DataFrame({"url_key": rows["url_key"], "digest": rows["content"].str.split("\n").str[0]})


@query(
    "digest_hook",
    "select url_key, split_part(content, chr(10), 1) as digest from page where length(content) > 8000",
    "page",
)
def digest_hook(d: Derived) -> DataFrame:
    """A stand-in model that quotes a page's first line."""
    return resolve.model_digests(d.page, _first_line)


# --- the whole job ---------------------------------------------------------------------

_KEPT = "kept as (select * from host_xref where internal_status not in ('do-not-contact', 'customer'))"


def _job(d: Derived) -> Enrichment:
    """Every host as an entity of its own."""
    d = d.over_stored_pages()
    host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
    hosts = d.given("pages").groupBy(host.alias("entity_name")).agg(F.min("page_id").alias("pos"))
    entities = hosts.select(
        "pos",
        "entity_name",
        F.regexp_extract("entity_name", r"([^.]+)\.example\.", 1).alias("name"),
        F.col("entity_name").alias("domain"),
    )
    return Enrichment(
        entities, d.known, d.page_request, d.page_outcome, d.page_cache, d.claim, d.stored_page, AS_OF
    )


@query(
    "enrich_rows",
    _KEPT
    + """ select c.claim_id, c.run_id, c.entity_name, c.field, case when c.verified then c.value else '' end as value, c.source_url, c.verified,
      case when c.verified then '' else 'NOT FOUND — searched ' || c.source_url end as note, k.internal_status, k.internal_ref, k.internal_note
    from checked_claim c join kept k using (entity_name)""",
    "checked_claim host_xref",
)
def enrich_rows(d: Derived) -> DataFrame:
    return _job(d).rows


@query(
    "enrich_telemetry",
    _KEPT
    + f""", by_rung as (select r.run_id, r.entity_name, e.rung, count(*) as n, count(*) filter (where e.success) as won, sum(e.latency_ms) as ms,
        sum(e.cost_credits) as credits, count(*) filter (where e.from_cache) as hits
      from fetch_event e join page_request r using (req) join kept k on k.entity_name = r.entity_name group by 1, 2, 3),
    spent as (select run_id, entity_name, sum(n) as n, sum(ms) as ms, sum(credits) as credits, sum(hits) as hits,
        string_agg(rung || ':' || cast(won as varchar), ',' order by rung) filter (where won > 0) as rung_hits from by_rung group by 1, 2),
    counts as (select run_id, entity_name, count(*) filter (where verified) as v, count(*) filter (where not verified) as u
      from checked_claim join kept using (entity_name) group by 1, 2)
    select run_id, entity_name, {q.canon_domain('entity_name')} as entity_domain, internal_status, coalesce(rung_hits, '') as rung_hits,
      cast(ms as bigint) as duration_ms, cast(coalesce(n, 0) as bigint) as orchestrator_turns, cast(coalesce(credits, 0) as bigint) as credits_spent,
      cast(coalesce(hits, 0) as bigint) as cache_hits, coalesce(v, 0) as verified_fields, coalesce(u, 0) as unverified_fields
    from spent full join counts using (run_id, entity_name) join kept using (entity_name)""",
    "checked_claim host_xref fetch_event page_request",
)
def enrich_telemetry(d: Derived) -> DataFrame:
    """Telemetry of every entity of the job, as its table holds it."""
    rows = _job(d).entity_telemetry
    pairs = F.transform(F.array_sort(F.map_entries("rung_hits")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    names = ["orchestrator_turns", "credits_spent", "cache_hits", "verified_fields", "unverified_fields"]
    return rows.select(
        "run_id", "entity_name", "entity_domain", "internal_status",
        F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("rung_hits"), "duration_ms", *names,
    )


@query(
    "enrich_report",
    _KEPT
    + """, spent as (select r.run_id, r.entity_name, count(*) as n, count(*) filter (where e.from_cache) as hits, sum(e.cost_credits) as credits,
      sum(e.cost_usd) as usd from fetch_event e join page_request r using (req) join kept k on k.entity_name = r.entity_name group by 1, 2),
    counts as (select run_id, entity_name, count(*) filter (where verified) as v, count(*) filter (where not verified) as u
      from checked_claim join kept using (entity_name) group by 1, 2)
    select run_id, cast(sum(coalesce(n, 0)) as bigint) as attempts, cast(sum(coalesce(hits, 0)) as bigint) as cache_hits, cast(sum(coalesce(credits, 0)) as bigint) as credits,
      round(sum(coalesce(usd, 0)), 6) as usd, round(sum(coalesce(v, 0)) / nullif(sum(coalesce(v, 0) + coalesce(u, 0)), 0), 10) as verified_rate, count(*) as entities
    from spent full join counts using (run_id, entity_name) group by 1""",
    "checked_claim host_xref fetch_event page_request",
)
def enrich_report(d: Derived) -> DataFrame:
    report = _job(d).report
    return report.withColumns(
        {
            "usd": F.round(F.col("usd").cast("double"), 6),
            "verified_rate": F.round("verified_rate", 10),
        }
    )
