"""Scans, sinks, row predicates, keys and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions import keys, text
from enrichspark.functions.policy import DEFAULT_POLICY, configured_col, gate_col, policy_col, rungs
from enrichspark.operators import accounts, cache, facts, resolve, scan, telemetry
from enrichspark.plans import oracle as q
from enrichspark.plans.registry import query
from enrichspark.session import scratch_path
from enrichspark.sources import files, sinks, tables
from enrichspark.sources.derived import AS_OF, Derived

NOW = q.NOW


def _stored(d: Derived, name: str, df: DataFrame) -> str:
    """Write a table where all executors can read it back."""
    path = scratch_path(d.spark, name)
    df.write.parquet(path)
    return path


# --- A: scans and sinks ----------------------------------------------------------


@query(
    "src_entities",
    "select page_id, cast(nth - 1 as integer) as pos, label as name, href as domain from anchor",
    "anchor",
)
def src_entities(d: Derived) -> DataFrame:
    """Each page's links as an entity list in a job file, read back one row per entity."""
    listed = F.transform("links", lambda a: F.struct(a["label"].alias("name"), a["href"].alias("domain")))
    jobs = d.anchor.select(listed.alias("entities"), F.col("page_id").cast("string").alias("brief"))
    path = scratch_path(d.spark, "jobs")
    jobs.write.json(path)
    rows = files.read_job(d.spark, path, multi_line=False)
    return rows.select(
        F.col("brief").cast("long").alias("page_id"), F.posexplode("entities").alias("pos", "e")
    ).select("page_id", "pos", "e.name", "e.domain")


@query(
    "src_pages",
    f"select url_key, url, provider, expires_at from page_cache where expires_at > {NOW} and not is_dead",
    "page_cache",
)
def src_pages(d: Derived) -> DataFrame:
    stored = tables.read_pages(d.spark, _stored(d, "pages", d.page_cache.select(*cache.PAGE_COLUMNS)))
    return cache.live(stored, AS_OF).where(~F.col("is_dead")).select("url_key", "url", "provider", "expires_at")


@query(
    "src_search",
    "select query_key, query, empty, cast(case when empty then 0 else 8 end as integer) as results, expires_at from search_cache",
    "search_cache",
)
def src_search(d: Derived) -> DataFrame:
    stored = tables.read_search(d.spark, _stored(d, "searches", d.search_cache))
    return stored.select("query_key", "query", "empty", F.size("result_urls").alias("results"), "expires_at")


def _run_rows(d: Derived) -> DataFrame:
    return telemetry.create_runs(
        d.run.select(F.col("run_id").cast("string").alias("run_id"), "model"), AS_OF
    )


@query("src_runs", "select cast(run_id as varchar) as run_id, model, 'running' as status from run", "run")
def src_runs(d: Derived) -> DataFrame:
    stored = tables.read_runs(d.spark, _stored(d, "runs", _run_rows(d)))
    return stored.select("run_id", "model", "status")


@query(
    "src_telemetry",
    "select cast(run_id as varchar) as run_id, entity_name, tokens_in, verified_fields, created_at from entity_telemetry",
    "entity_telemetry",
)
def src_telemetry(d: Derived) -> DataFrame:
    rows = telemetry.fold_telemetry(d.telemetry_delta).withColumn("run_id", F.col("run_id").cast("string"))
    rows = rows.withColumn("usd_spent", F.col("usd_spent").cast("decimal(18,6)"))
    stored = tables.read_telemetry(d.spark, _stored(d, "telemetry", rows))
    return stored.select("run_id", "entity_name", "tokens_in", "verified_fields", "created_at")


@query(
    "src_events",
    "select cast(run_id as varchar) as run_id, entity_name, rung, success, ts from rung_event where tier = 'free'",
    "rung_event",
)
def src_events(d: Derived) -> DataFrame:
    stored = tables.read_events(d.spark, _stored(d, "events", tables.event_rows(d.rung_event)))
    return stored.where("tier = 'free'").select("run_id", "entity_name", "rung", "success", "ts")


@query("src_known", "select id, company_name, domain, domain_normalized, status, notes from known", "known")
def src_known(d: Derived) -> DataFrame:
    stored = tables.read_known(d.spark, _stored(d, "known", d.known))
    return stored.select("id", "company_name", "domain", "domain_normalized", "status", "notes")


@query(
    "src_files",
    "select cast(sum(length(text) + 1) as bigint) as chars, "
    "cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines from documents",
)
def src_files(d: Derived) -> DataFrame:
    """All documents written as text files of bounded size and read back whole."""
    path = scratch_path(d.spark, "texts")
    sinks.write_texts(d.given("documents"), path)
    content = F.col("content")
    return files.read_files(d.spark, path, "*.txt").agg(
        F.sum(F.length(content)).alias("chars"),
        F.sum(F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).alias("lines"),
    )


@query(
    "sink_event_append",
    "select strftime(ts, '%Y-%m') as month, rung, count(*) as events, "
    "cast(sum(cost_credits) as bigint) as credits, round(sum(cost_usd), 6) as usd from rung_event group by 1, 2",
    "rung_event",
)
def sink_event_append(d: Derived) -> DataFrame:
    """Two appends, cached and fresh attempts, read back by month folder."""
    path = scratch_path(d.spark, "event-log")
    sinks.append_events(d.rung_event.where("from_cache").drop("cost_usd", "cost_credits"), path)
    sinks.append_events(d.rung_event.where("not from_cache"), path)
    log = d.spark.read.parquet(path).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return log.groupBy("month", "rung").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("cost_credits").alias("credits"),
        F.round(F.sum("cost_usd").cast("double"), 6).alias("usd"),
    )


@query(
    "sink_rows",
    """best as (select * from fact where verified qualify row_number() over (partition by entity_name, field
      order by value <> '' and source_url <> '' desc, source_url, value, note) = 1)
    select entity_name, max(value) filter (where field = 'hq_city') as hq_city, max(value) filter (where field = 'employee_count') as employee_count,
      max(value) filter (where field = 'ceo') as ceo, cast(null as bigint) as verified, cast(null as bigint) as unverified from best group by 1
    union all select null, null, null, null, count(*) filter (where verified), count(*) filter (where not verified) from fact""",
    "fact",
)
def sink_rows(d: Derived) -> DataFrame:
    """Result rows and their summary, both written and read back."""
    path = scratch_path(d.spark, "rows")
    wide = facts.pivot_facts(facts.trusted(d.fact), ("hq_city", "employee_count", "ceo"))
    counts = d.fact.agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))
    sinks.write_rows(wide, counts, path, "json")
    rows = d.spark.read.schema("entity_name string, hq_city string, employee_count string, ceo string").json(f"{path}/rows")
    summary = d.spark.read.schema("verified long, unverified long").json(f"{path}/summary")
    return rows.unionByName(summary, allowMissingColumns=True)


# --- B: row predicates ---------------------------------------------------------------


@query(
    "ttl_live",
    f"select page_id, http_status, is_dead, expires_at from page_core where expires_at > {NOW}",
    "page_core",
)
def ttl_live(d: Derived) -> DataFrame:
    return cache.live(d.page_core, AS_OF).select("page_id", "http_status", "is_dead", "expires_at")


@query("ttl_assign", "select page_id, is_dead, fetched_at, expires_at from page_core", "page_core")
def ttl_assign(d: Derived) -> DataFrame:
    return d.page_core.select("page_id", "is_dead", "fetched_at", "expires_at")


@query(
    "dead_flag",
    "select event_id, status, status in (401, 404, 410) as is_dead from "
    "(select event_id, case event_type when 'view' then 200 when 'click' then 401 when 'signup' then 403 "
    "when 'purchase' then 404 else 410 end as status from events)",
)
def dead_flag(d: Derived) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", 200).when(kind == "click", 401).when(kind == "signup", 403)
    rows = d.given("events").select("event_id", status.when(kind == "purchase", 404).otherwise(410).alias("status"))
    return text.with_dead(rows, "status")


@query("usable", f"select url_key, rung, {q.usable('content')} as usable from page_outcome", "page_outcome")
def usable(d: Derived) -> DataFrame:
    return text.with_usable(d.page_outcome).select("url_key", "rung", "usable")


@query(
    "min_len_gate",
    f"select page_id, length({q.strip('content')}) >= 500 as reader_ok, length({q.strip('content')}) >= 200 as extract_ok from page_text",
    "page_text",
)
def min_len_gate(d: Derived) -> DataFrame:
    body = F.col("content")
    return d.page_text.select(
        "page_id",
        text.long_enough(body, C.READER_MIN_CHARS).alias("reader_ok"),
        text.long_enough(body, C.EXTRACT_MIN_CHARS).alias("extract_ok"),
    )


@query(
    "js_shell_flag",
    f"select url_key, rung, not (ok and {q.usable('content')}) and status not in (401, 404, 410) "
    f"and {q.strip('content')} <> '' as is_js_shell from page_outcome",
    "page_outcome",
)
def js_shell_flag(d: Derived) -> DataFrame:
    return text.with_shell(d.page_outcome).select("url_key", "rung", "is_js_shell")


_CTX = """(select event_id, value < 15 as empty, value < 50 as failed, event_type = 'view' as shell,
  case when event_type in ('signup', 'purchase') then 'semantic' else 'keyword' end as intent,
  event_id % 2 = 0 as allowed, event_id % 5 = 0 as by_user from events) e"""


def _contexts(d: Derived) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    return d.given("events").select(
        "event_id",
        (value < 15).alias("prev_rungs_empty"),
        (value < 50).alias("prev_rung_failed"),
        (kind == "view").alias("is_js_shell"),
        F.when(kind.isin("signup", "purchase"), "semantic").otherwise("keyword").alias("query_intent"),
        (F.pmod("event_id", F.lit(2)) == 0).alias("allow_parallel"),
        (F.pmod("event_id", F.lit(5)) == 0).alias("user_invocation"),
    )


@query(
    "policy_predicate",
    f"""select event_id, waterfall, rung, case waterfall || ':' || rung
        when 'search:keyword' then true when 'search:exa' then empty and intent = 'semantic'
        when 'search:tavily' then empty when 'search:parallel' then empty
        when 'fetch:native' then true when 'fetch:jina' then failed or shell else failed end as fires
    from {_CTX}, (values ('search', 'keyword'), ('search', 'exa'), ('search', 'tavily'), ('search', 'parallel'),
      ('fetch', 'native'), ('fetch', 'jina'), ('fetch', 'tavily'), ('fetch', 'parallel')) p(waterfall, rung)""",
)
def policy_predicate(d: Derived) -> DataFrame:
    ctx = {c: F.col(c) for c in ("prev_rungs_empty", "prev_rung_failed", "is_js_shell", "query_intent")}
    tests = F.array(
        *[
            F.struct(
                F.lit(r.waterfall).alias("waterfall"),
                F.lit(r.rung).alias("rung"),
                policy_col(r.invoke_when, ctx).alias("fires"),
            )
            for r in DEFAULT_POLICY
        ]
    )
    return _contexts(d).select("event_id", F.inline(tests))


@query(
    "gate_filter",
    f"""select event_id, rung from {_CTX}, (values ('keyword'), ('exa'), ('tavily'), ('parallel')) p(rung)
    where rung <> 'parallel' or allowed or by_user""",
)
def gate_filter(d: Derived) -> DataFrame:
    allowed, user = {"parallel": F.col("allow_parallel")}, F.col("user_invocation")
    tests = F.array(
        *[
            F.struct(F.lit(r.rung).alias("rung"), gate_col(r, allowed, user).alias("cleared"))
            for r in rungs("search")
        ]
    )
    return _contexts(d).select("event_id", F.inline(tests)).where("cleared").drop("cleared")


@query(
    "configured_filter",
    "select event_id, rung from rung_event where rung in ('keyword', 'native', 'jina', 'ddg', 'tavily')",
    "rung_event",
)
def configured_filter(d: Derived) -> DataFrame:
    return d.rung_event.where(configured_col(F.col("rung"), ["tavily"])).select("event_id", "rung")


@query(
    "digest_gate",
    "select req, length(content) as chars from fetch_content where not from_cache and length(content) > 8000",
    "fetch_content",
)
def digest_gate(d: Derived) -> DataFrame:
    got = fetched_content(d)
    long_ = text.needs_digest(F.col("content"), F.col("from_cache"))
    return got.where(long_).select("req", F.length("content").cast("long").alias("chars"))


@query("trust_only_verified", "select fact_id, entity_name, field, value from fact where verified", "fact")
def trust_only_verified(d: Derived) -> DataFrame:
    return facts.trusted(d.fact).select("fact_id", "entity_name", "field", "value")


@query(
    "suppress",
    "select pos, name, internal_status from xref where internal_status not in ('do-not-contact', 'customer')",
    "xref",
)
def suppress(d: Derived) -> DataFrame:
    return accounts.suppress(accounts.xref(d.entity, d.known)).select("pos", "name", "internal_status")


@query("free_tier", "select event_id, rung, tier from rung_event where tier = 'free'", "rung_event")
def free_tier(d: Derived) -> DataFrame:
    return d.rung_event.where("tier = 'free'").select("event_id", "rung", "tier")


@query(
    "include_exclude_domains",
    f"""select page_id, url from (select page_id, url, {q.host('url')} as h from pages)
    where (h like '%.example.com' or h like '%.example.org') and h not like '%.cheap-pills.example.com'
      and h <> 'cheap-pills.example.com'""",
)
def include_exclude_domains(d: Derived) -> DataFrame:
    kept = resolve.filter_domains(
        d.given("pages"),
        keys.url_host(F.col("url")),
        include=["example.com", "example.org"],
        exclude=["cheap-pills.example.com"],
    )
    return kept.select("page_id", "url")


# --- C: keys and text ------------------------------------------------------------------


@query("canon_url", f"select req, {q.canon_url('url')} as canon_url from page_request", "page_request")
def canon_url(d: Derived) -> DataFrame:
    return keys.with_canon_url(d.page_request).select("req", "canon_url")


@query("url_key", "select req, url_key from keyed_request", "keyed_request")
def url_key(d: Derived) -> DataFrame:
    return keys.with_url_key(d.page_request).select("req", "url_key")


@query(
    "canon_query",
    f"select conv_id, turn, {q.canon_query('text')} as canon_query from conversations",
)
def canon_query(d: Derived) -> DataFrame:
    return keys.with_canon_query(d.given("conversations"), "text").select("conv_id", "turn", "canon_query")


@query("query_key", "select req, query_key from keyed_search", "keyed_search")
def query_key(d: Derived) -> DataFrame:
    return keys.with_query_key(d.search_request).select("req", "query_key")


@query("content_key", "select url_key, content_hash from page_cache", "page_cache")
def content_key(d: Derived) -> DataFrame:
    return keys.with_content_key(d.page_cache).select("url_key", F.col("content_key").alias("content_hash"))


@query("canon_domain", f"select req, {q.canon_domain('url')} as canon_domain from page_request", "page_request")
def canon_domain(d: Derived) -> DataFrame:
    return keys.with_canon_domain(d.page_request, "url").select("req", "canon_domain")


@query("html_text", f"select page_id, {q.html_text('html')} as content from pages")
def html_text(d: Derived) -> DataFrame:
    return text.with_page_text(d.given("pages"), mode="named").select("page_id", "content")


@query("html_text_all_entities", f"select page_id, {q.html_text('html')} as content from pages")
def html_text_all_entities(d: Derived) -> DataFrame:
    """The Arrow path that decodes every entity; these pages only use the common ones."""
    return text.with_page_text(d.given("pages"), mode="full").select("page_id", "content")


@query(
    "strip_tags",
    "select page_id, " + q.strip("regexp_replace(html, '<[^>]+>', '', 'g')") + " as plain from pages",
)
def strip_tags(d: Derived) -> DataFrame:
    return d.given("pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("excerpt", "select page_id, substr(content, 1, 4000) as excerpt, substr(content, 1, 600) as cut from page_text", "page_text")
def excerpt(d: Derived) -> DataFrame:
    body = F.col("content")
    return d.page_text.select(
        "page_id", text.excerpt(body).alias("excerpt"), text.excerpt(body, C.RESULT_CHARS).alias("cut")
    )


@query(
    "truncate_long",
    "select doc_id, case when length(text) > 8000 then substr(text, 1, 8000) || chr(10) || chr(10) || "
    "'[...truncated; digest unavailable...]' else text end as text from documents",
)
def truncate_long(d: Derived) -> DataFrame:
    return text.truncate_long(d.given("documents"), col="text").select("doc_id", "text")


@query(
    "cached_body",
    "select url_key, coalesce(nullif(digest, ''), nullif(raw_excerpt, ''), '') as body from page_cache",
    "page_cache",
)
def cached_body(d: Derived) -> DataFrame:
    return cache.body_of(d.page_cache)


_SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), "
    f"lambda s: {q.strip('s')}), lambda s: s <> '')"
)


@query(
    "quote_extract",
    f"""select url_key, field, nth, quote, found from (
      select url_key, field, len(hits) > 0 as found,
        unnest(case when len(hits) > 0 then hits else ['ABSENT'] end) as quote,
        unnest(range(1, greatest(len(hits), 1) + 1)) as nth
      from (select url_key, field, list_filter({_SENTENCES}, lambda s: contains(lower(s), t1) or contains(lower(s), t2) or contains(lower(s), t3)) as hits
        from (select url_key, content, 'article' as field, 'the ' as t1, 'der ' as t2, 'les ' as t3 from page
          union all select url_key, content, 'host', host, host, host from page)))""",
    "page",
)
def quote_extract(d: Derived) -> DataFrame:
    return facts.extract_quotes(d.page, d.want)


def _scan_sql(rules: tuple) -> str:
    parts = []
    for r in rules:
        flags = "i" if r.any_case else ""
        pattern = r.pattern.replace("'", "''")
        hit = f"regexp_matches(line, '(?{flags}s){pattern}')" if flags else f"regexp_matches(line, '{pattern}')"
        if r.allowed:
            hit += f" and not regexp_matches(line, '(?i){r.allowed}')"
        parts.append(f"select doc_id, line_no, '{r.name}' as rule, line from scan_lines where {hit}")
    lines = (
        "scan_lines as (select doc_id, unnest(string_split(text, chr(10))) as line, "
        "unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)"
    )
    return f"with {lines}, found as ({' union all '.join(parts)})"


SCAN_RULES = (*scan.DEFAULT_RULES, scan.SECRET_ANY_CASE, *scan.deny_terms(r"api_key\s*=", "lorem", r"^licensed under", r"version 2\.0\.$"))


@query("leak_scan", _scan_sql(SCAN_RULES) + " select doc_id, line_no, rule, line from found")
def leak_scan(d: Derived) -> DataFrame:
    return scan.leak_scan(d.given("documents"), SCAN_RULES)


_CHECKS = ", ".join(f"('{r.check}', '{r.name}')" for r in SCAN_RULES)


@query(
    "leak_verdict",
    _scan_sql(SCAN_RULES)
    + f""", per as (select c.name, count(f.doc_id) as n from (values {_CHECKS}) c(name, rule)
      left join found f on f.rule = c.rule group by c.name)
    select name as "check", n as findings, n = 0 as passed from per
    union all select 'overall', cast(sum(n) as bigint), sum(n) = 0 from per""",
)
def leak_verdict(d: Derived) -> DataFrame:
    return scan.leak_verdict(scan.leak_scan(d.given("documents"), SCAN_RULES), SCAN_RULES)


# --- used by several queries ---------------------------------------------------------------


def fetched_content(d: Derived) -> DataFrame:
    got = resolve.resolve_fetch(d.page_request, d.page_outcome, d.page_cache, AS_OF)
    return resolve.with_content(got.resolved, d.page_outcome, d.page_cache)
