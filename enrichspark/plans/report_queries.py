"""Joins, aggregations, windows and table updates over telemetry, caches and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.keys import canon_domain, with_canon_domain, with_query_key, with_url_key
from enrichspark.operators import accounts, cache, facts, health, resolve, telemetry
from enrichspark.plans import oracle as q
from enrichspark.plans.registry import query
from enrichspark.sources.derived import AS_OF, FIELDS, Derived

NOW = q.NOW


def _usd(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6)


def _ratio(name: str) -> Column:
    """Ratios are compared to ten digits: at six, quotients that end in a five there are common,
    and engines round those differently."""
    return F.round(F.col(name).cast("double"), 10)


# --- E: joins ------------------------------------------------------------------------


@query(
    "xref_domains",
    f"""select e.pos, e.domain, coalesce(k.status, 'net-new') as status, k.company_name, k.notes
    from entity e left join (select * from known where domain_normalized is not null
      qualify row_number() over (partition by domain_normalized order by id) = 1) k
      on k.domain_normalized = {q.canon_domain('e.domain')}""",
    "entity known",
)
def xref_domains(d: Derived) -> DataFrame:
    return accounts.check_domains(d.entity.select("pos", "domain"), d.known)


@query("xref_entity", "select * from xref", "xref")
def xref_entity(d: Derived) -> DataFrame:
    return accounts.xref(d.entity, d.known)


@query(
    "cache_probe_page",
    """select r.req, case when c.url_key is null then 'miss' when c.is_dead then 'dead' else 'live' end as probe,
      c.http_status as cached_status, coalesce(nullif(c.digest, ''), nullif(c.raw_excerpt, ''), '') <> '' and c.url_key is not null as cached_has_body
    from keyed_request r left join live c using (url_key)""",
    "keyed_request live",
)
def cache_probe_page(d: Derived) -> DataFrame:
    probed = cache.probe_pages(with_url_key(d.page_request), d.page_cache, AS_OF)
    has_body = F.coalesce("cached_has_body", F.lit(False)).alias("cached_has_body")
    return probed.select("req", "probe", "cached_status", has_body)


@query(
    "cache_probe_search",
    f"""select r.req, c.query_key is not null as hit, c.empty as cached_empty from keyed_search r
    left join (select * from search_cache where expires_at > {NOW}) c using (query_key)""",
    "keyed_search search_cache",
)
def cache_probe_search(d: Derived) -> DataFrame:
    probed = cache.probe_search(with_query_key(d.search_request), d.search_cache, AS_OF)
    return probed.select("req", "hit", "cached_empty")


@query(
    "cache_miss",
    "select req, url_key from keyed_request where url_key not in (select url_key from live)",
    "keyed_request live",
)
def cache_miss(d: Derived) -> DataFrame:
    return cache.misses(with_url_key(d.page_request), d.page_cache, AS_OF).select("req", "url_key")


_COST = """select r.run_id, r.model, cast(sum(t.credits_spent) as bigint) as tavily_credits, round(sum(t.usd_spent), 6) as api_usd,
  cast(sum(t.tokens_in + t.tokens_out) as bigint) as orchestrator_tokens, cast(sum(t.orchestrator_turns) as bigint) as orchestrator_turns,
  cast(sum(t.cache_hits) as bigint) as cache_hits from run r join entity_telemetry t using (run_id) group by r.run_id, r.model"""


@query("run_cost_split", _COST, "run entity_telemetry")
def run_cost_split(d: Derived) -> DataFrame:
    return telemetry.cost_split(d.run, d.entity_telemetry).withColumn("api_usd", _usd("api_usd"))


@query(
    "cost_split_join",
    "select r.run_id, r.model, t.entity_name, t.credits_spent from run r join entity_telemetry t using (run_id)",
    "run entity_telemetry",
)
def cost_split_join(d: Derived) -> DataFrame:
    tel = d.entity_telemetry.select("run_id", "entity_name", "credits_spent")
    return d.run.select("run_id", "model").join(tel, "run_id")


_BURN = "select rung, date_trunc('month', ts) as month, count(*) as calls from rung_event where tier = 'free' group by 1, 2"


@query(
    "budget_join",
    f"""with_burn as ({_BURN}) select p.rung, m.month, p.monthly_free, coalesce(b.calls, 0) as calls,
      p.monthly_free - coalesce(b.calls, 0) as remaining, coalesce(coalesce(b.calls, 0) > p.monthly_free, false) as over_budget
    from (select distinct month from with_burn) m, (values ('brave', 2000), ('serper', 2500), ('exa', 1000), ('jina', null),
      ('tavily', 1000), ('parallel', null)) p(rung, monthly_free) left join with_burn b on b.rung = p.rung and b.month = m.month""",
    "rung_event",
)
def budget_join(d: Derived) -> DataFrame:
    return telemetry.budget_status(telemetry.free_pool_month(d.rung_event))


@query(
    "one_time_pool",
    """select 'parallel' as rung, 18000 as one_time_free, count(*) as calls, greatest(18000 - count(*), 0) as remaining, count(*) >= 18000 as used_up
    from rung_event where rung = 'parallel' and not from_cache""",
    "rung_event",
)
def one_time_pool(d: Derived) -> DataFrame:
    return telemetry.one_time_status(d.rung_event)


@query(
    "finish_runs",
    f"""select r.run_id, 'done' as status, {NOW} as finished_at, round(t.rate, 10) as verified_rate from run r left join
    (select run_id, sum(verified_fields) / nullif(sum(verified_fields + unverified_fields), 0) as rate from entity_telemetry group by 1) t using (run_id)""",
    "run entity_telemetry",
)
def finish_runs(d: Derived) -> DataFrame:
    done = telemetry.finish_runs(d.run, d.entity_telemetry, AS_OF)
    return done.select("run_id", "status", "finished_at", _ratio("verified_rate").alias("verified_rate"))


@query(
    "cascade_delete",
    """select 'run' as child, run_id, count(*) as kept from run where status <> 'done' group by 2
    union all select 'entity_telemetry', run_id, count(*) from entity_telemetry where run_id not in (select run_id from run where status = 'done') group by 2
    union all select 'rung_event', run_id, count(*) from rung_event where run_id not in (select run_id from run where status = 'done') group by 2""",
    "run entity_telemetry rung_event",
)
def cascade_delete(d: Derived) -> DataFrame:
    """Runs that are done go, with their telemetry and events."""
    gone = d.run.where("status = 'done'").select("run_id")
    left = [
        telemetry.drop_runs(df, gone).groupBy("run_id").agg(F.count(F.lit(1)).alias("kept")).withColumn("child", F.lit(n))
        for n, df in (("run", d.run), ("entity_telemetry", d.entity_telemetry), ("rung_event", d.rung_event))
    ]
    return left[0].unionByName(left[1]).unionByName(left[2])


@query("verify_join", "select claim_id, url_key, verified from checked_claim", "checked_claim")
def verify_join(d: Derived) -> DataFrame:
    """Claims go to where the stored pages lie."""
    d = d.over_stored_pages()
    return facts.verify_claims(d.claim, d.stored_page).select("claim_id", "url_key", "verified")


_DOMAIN_FACT = """select canon_domain, min(page_id) as lead, count(*) as pages
  from (select page_id, {d} as canon_domain from pages) where canon_domain is not null group by 1"""


@query(
    "sibling_share",
    f"""df as ({_DOMAIN_FACT.format(d=q.canon_domain('url'))})
    select e.pos, e.name, df.canon_domain, df.lead as fact_page, df.pages from entity e join df on df.canon_domain = {q.canon_domain('e.domain')}""",
    "entity",
)
def sibling_share(d: Derived) -> DataFrame:
    """A fact per domain, found once, copied to every entity of that domain."""
    found = with_canon_domain(d.given("pages"), "url").groupBy("canon_domain")
    found = found.agg(F.min("page_id").alias("fact_page"), F.count(F.lit(1)).alias("pages"))
    shared = accounts.share_by_domain(d.entity, found)
    return shared.select("pos", "name", "canon_domain", "fact_page", "pages")


@query(
    "xref_copy",
    """one as (select name, min(internal_status) as internal_status, min(internal_ref) as internal_ref, min(internal_note) as internal_note from xref group by 1)
    select f.fact_id, f.entity_name, one.internal_status, one.internal_ref, one.internal_note from fact f left join one on one.name = f.entity_name""",
    "xref fact",
)
def xref_copy(d: Derived) -> DataFrame:
    cols = ["internal_status", "internal_ref", "internal_note"]
    per_entity = accounts.xref(d.entity, d.known).groupBy(F.col("name").alias("entity_name"))
    per_entity = per_entity.agg(*[F.min(c).alias(c) for c in cols])
    return accounts.attach_xref(d.fact, per_entity).select("fact_id", "entity_name", *cols)


@query(
    "suppress_anti",
    f"""select pos, name, domain from entity where domain is null or {q.canon_domain('domain')} not in
    (select domain_normalized from known where domain_normalized is not null and status in ('customer', 'do-not-contact'))""",
    "entity known",
)
def suppress_anti(d: Derived) -> DataFrame:
    return accounts.suppress_domains(d.entity, d.known)


_SPLIT_NATIVE = "select url_key from page_outcome where rung = 'native' and ok"


@query(
    "pending_split",
    f"""select req, 'native' as stage from keyed_request where url_key in ({_SPLIT_NATIVE})
    union all select req, 'jina' from keyed_request where url_key not in ({_SPLIT_NATIVE})
      and url_key in (select url_key from page_outcome where rung = 'jina' and ok)
    union all select req, 'pending' from keyed_request where url_key not in ({_SPLIT_NATIVE})
      and url_key not in (select url_key from page_outcome where rung = 'jina' and ok)""",
    "keyed_request page_outcome",
)
def pending_split(d: Derived) -> DataFrame:
    requests = with_url_key(d.page_request).select("req", "url_key")
    outcomes = d.page_outcome.select("url_key", "rung", "ok")
    first, pending = resolve.pending_split(requests, outcomes, "native", "url_key")
    second, pending = resolve.pending_split(pending, outcomes, "jina", "url_key")
    stages = (("native", first), ("jina", second), ("pending", pending))
    parts = [df.select("req", F.lit(n).alias("stage")) for n, df in stages]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- F: aggregations --------------------------------------------------------------------


@query(
    "run_verified_rate",
    """select run_id, round(sum(verified_fields) / nullif(sum(verified_fields + unverified_fields), 0), 10) as verified_rate,
    count(*) as entities from entity_telemetry group by 1""",
    "entity_telemetry",
)
def run_verified_rate(d: Derived) -> DataFrame:
    return telemetry.verified_rate(d.entity_telemetry).withColumn("verified_rate", _ratio("verified_rate"))


@query("free_pool_month", _BURN, "rung_event")
def free_pool_month(d: Derived) -> DataFrame:
    return telemetry.free_pool_month(d.rung_event)


@query(
    "telemetry_fold",
    """select run_id, entity_name, orchestrator_turns, tokens_in, tokens_out, credits_spent, round(usd_spent, 6) as usd_spent, cache_hits,
    verified_fields, unverified_fields, entity_domain, internal_status, duration_ms, created_at from entity_telemetry""",
    "entity_telemetry",
)
def telemetry_fold(d: Derived) -> DataFrame:
    folded = telemetry.fold_telemetry(d.telemetry_delta).drop("rung_hits")
    return folded.withColumn("usd_spent", _usd("usd_spent"))


@query(
    "rung_hits_merge",
    "select run_id, entity_name, rung, cast(arg_max(tokens_in, seq) as bigint) as hits from delta group by 1, 2, 3",
    "delta",
)
def rung_hits_merge(d: Derived) -> DataFrame:
    folded = telemetry.fold_telemetry(d.telemetry_delta)
    return folded.select("run_id", "entity_name", F.explode("rung_hits").alias("rung", "hits"))


@query(
    "dedupe_by_domain",
    f"""keyed as (select *, nullif(lower({q.strip('domain')}), '') as dom from entity),
    grouped as (select dom, coalesce(dom, cast(pos as varchar)) as grp, pos from keyed),
    firsts as (select grp, any_value(dom) as dom, min(pos) as first_pos, count(*) as group_size from grouped group by grp),
    ranked as (select *, row_number() over (order by first_pos) - 1 as k from firsts)
    select g.pos, coalesce(r.dom, '_nodomain_' || cast(r.k as varchar)) as group_key, r.group_size from grouped g join ranked r using (grp)""",
    "entity",
)
def dedupe_by_domain(d: Derived) -> DataFrame:
    return accounts.group_by_domain(d.entity).select("pos", "group_key", "group_size")


@query(
    "rung_success",
    """select waterfall, rung, count(*) as attempts, cast(sum(case when success then 1 else 0 end) as bigint) as successes,
    round(sum(case when success then 1 else 0 end) / count(*), 10) as success_rate, round(avg(latency_ms), 10) as avg_latency_ms
    from rung_event group by 1, 2""",
    "rung_event",
)
def rung_success(d: Derived) -> DataFrame:
    stats = telemetry.rung_stats(d.rung_event)
    return stats.withColumns({"success_rate": _ratio("success_rate"), "avg_latency_ms": _ratio("avg_latency_ms")})


@query(
    "rung_latency_p95",
    """select waterfall, rung, count(latency_ms) as timed, quantile_disc(latency_ms, 0.95) as p95_latency_ms from rung_event group by 1, 2""",
    "rung_event",
)
def rung_latency_p95(d: Derived) -> DataFrame:
    return telemetry.rung_percentile(d.rung_event).withColumnRenamed("latency_ms", "p95_latency_ms")


@query(
    "tier_cost_rollup",
    """per as (select coalesce(tier, 'total') as tier, count(*) as ops, cast(sum(cost_credits) as bigint) as credits, sum(cost_usd) as low
      from rung_event group by rollup (tier))
    select tier, ops, round(ops / (select max(ops) from per), 10) as share, credits, round(low, 6) as cost_low,
      round(low + credits * 0.005, 6) as cost_high, round((low + credits * 0.005) / ops, 10) as unit_cost from per""",
    "rung_event",
)
def tier_cost_rollup(d: Derived) -> DataFrame:
    costs = telemetry.tier_costs(d.rung_event)
    return costs.withColumns(
        {c: _usd(c) for c in ("cost_low", "cost_high")} | {c: _ratio(c) for c in ("share", "unit_cost")}
    )


@query(
    "baseline_saving",
    """select ops, round(cost, 6) as cost, round(ops * 0.005, 6) as baseline, round(ops * 0.005 / nullif(cost, 0), 4) as ratio
    from (select count(*) as ops, sum(cost_usd) + sum(cost_credits) * 0.005 as cost from rung_event)""",
    "rung_event",
)
def baseline_saving(d: Derived) -> DataFrame:
    out = telemetry.saving(d.rung_event)
    return out.withColumns({"cost": _usd("cost"), "baseline": _usd("baseline"), "ratio": F.round("ratio", 4)})


_WATCHDOG = """newest as (select * from entity_telemetry qualify row_number() over (partition by run_id order by created_at desc, entity_name) <= 25),
  trail as (select run_id, sum(verified_fields) / nullif(sum(verified_fields + unverified_fields), 0) as rate, count(*) as n from newest group by 1),
  verdict as (select r.run_id, r.status, t.rate, case when t.rate is null then 0 else t.n end as entities,
    coalesce(t.n >= 25 and t.rate < 0.55, false) as paused from run r left join trail t using (run_id))"""


@query(
    "run_summary",
    _WATCHDOG
    + """, known_in as (select run_id, count(*) as entities_in from entity_telemetry group by 1),
    found as (select run_id, count(distinct entity_name) as entities_returned, count(*) filter (where verified) as verified,
      count(*) filter (where not verified) as unverified from fact group by 1)
    select i.run_id, i.entities_in, coalesce(f.entities_returned, 0) as entities_returned, coalesce(f.verified, 0) as verified,
      coalesce(f.unverified, 0) as unverified, coalesce(v.paused and v.status = 'running', false) as paused
    from known_in i left join found f using (run_id) left join verdict v using (run_id)""",
    "entity_telemetry run fact",
)
def run_summary(d: Derived) -> DataFrame:
    after = telemetry.pause_runs(d.run, telemetry.watchdog(d.entity_telemetry, d.run))
    return telemetry.run_summary(d.entity_telemetry, d.fact, after)


@query(
    "two_source_rule",
    f"""select regexp_extract(domain, 'example\\.[a-z]+') as entity_name, field, value, count(distinct {q.host('source_url')}) as sources
    from fact where verified and source_url <> '' group by 1, 2, 3 having count(distinct {q.host('source_url')}) >= 2""",
    "fact",
)
def two_source_rule(d: Derived) -> DataFrame:
    """Facts of a whole domain group, which its many hosts may support."""
    group = F.regexp_extract("domain", r"example\.[a-z]+", 0)
    return facts.two_sources(d.fact.withColumn("entity_name", group))


@query(
    "two_source_sketch",
    f"""select regexp_extract(domain, 'example\\.[a-z]+') as entity_name, field, value from fact
    where verified and source_url <> '' group by 1, 2, 3 having count(distinct {q.host('source_url')}) >= 2""",
    "fact",
)
def two_source_sketch(d: Derived) -> DataFrame:
    """The same rule from one sketch per day and value, merged over days."""
    group, day = F.regexp_extract("domain", r"example\.[a-z]+", 0), F.col("fact_id") % 7
    sketches = facts.source_sketches(d.fact.withColumns({"entity_name": group, "day": day}), ["day"])
    return facts.two_sources_of_sketches(sketches).select("entity_name", "field", "value")


@query(
    "cache_stats",
    f"""select provider, count(*) as entries, count(*) filter (where expires_at > {NOW} and not is_dead) as live,
      count(*) filter (where expires_at > {NOW} and is_dead) as live_dead, count(*) filter (where expires_at <= {NOW}) as expired,
      round(count(*) filter (where is_dead) / count(*), 10) as negative_ratio,
      round((sum(fetch_count) - count(*)) / sum(fetch_count), 10) as hit_ratio from page_cache group by 1""",
    "page_cache",
)
def cache_stats(d: Derived) -> DataFrame:
    stats = cache.cache_stats(d.page_cache, AS_OF)
    return stats.withColumns({c: _ratio(c) for c in ("negative_ratio", "hit_ratio")})


@query(
    "fetch_count",
    f"""select c.url_key, c.fetch_count + case when c.expires_at > {NOW} then coalesce(h.n, 0) else 0 end as fetch_count
    from page_cache c left join (select url_key, count(*) as n from keyed_request group by 1) h using (url_key)""",
    "page_cache keyed_request",
)
def fetch_count(d: Derived) -> DataFrame:
    return cache.bump(d.page_cache, with_url_key(d.page_request), AS_OF).select("url_key", "fetch_count")


@query(
    "changed_content",
    """select o.url_key, o.content_hash as old_hash, sha256(p.content) as new_hash from page_cache o join page p using (url_key)
    where o.content_hash <> sha256(p.content)""",
    "page_cache page",
)
def changed_content(d: Derived) -> DataFrame:
    """Stored entries against the page as it is now."""
    now = d.page.select("url_key", F.sha2("content", 256).alias("content_hash"))
    return cache.changed(d.page_cache, now)


# --- G: windows and orders -----------------------------------------------------------------


@query(
    "watchdog",
    _WATCHDOG
    + """ select run_id, round(rate, 10) as rate, entities, paused,
    case when paused then format('verified-rate {:.2f} < 0.55 over trailing {} entities', rate, entities) end as reason,
    case when paused and status = 'running' then 'paused' else status end as status from verdict""",
    "entity_telemetry run",
)
def watchdog(d: Derived) -> DataFrame:
    return telemetry.watchdog(d.entity_telemetry, d.run).withColumn("rate", _ratio("rate"))


@query(
    "watchdog_trail",
    """select run_id, entity_name, created_at, row_number() over w as nth,
    round(sum(verified_fields) over t / nullif(sum(verified_fields + unverified_fields) over t, 0), 10) as rate from entity_telemetry
    window w as (partition by run_id order by created_at, entity_name),
      t as (partition by run_id order by created_at, entity_name rows between 24 preceding and current row)""",
    "entity_telemetry",
)
def watchdog_trail(d: Derived) -> DataFrame:
    return telemetry.watchdog_trail(d.entity_telemetry).withColumn("rate", _ratio("rate"))


_LADDER = """ladder as (select url_key, rung, ok, case rung when 'native' then 1 when 'jina' then 2 when 'tavily' then 3 else 4 end as ordinal from page_outcome)"""


def _ladder(d: Derived) -> DataFrame:
    rung = F.col("rung")
    ordinal = F.when(rung == "native", 1).when(rung == "jina", 2).when(rung == "tavily", 3).otherwise(4)
    return d.page_outcome.select("url_key", "rung", "ok", ordinal.alias("ordinal"))


@query(
    "first_success",
    _LADDER + " select url_key, min(case when ok then ordinal end) as winner, count(*) as offered from ladder group by 1",
    "page_outcome",
)
def first_success(d: Derived) -> DataFrame:
    return resolve.first_success(_ladder(d), "url_key")


@query(
    "sticky_flags",
    _LADDER
    + """ select url_key, rung, not coalesce(bool_or(ok) over w, false) as prev_rungs_empty, coalesce(bool_or(not ok) over w, false) as prev_rung_failed
    from ladder window w as (partition by url_key order by ordinal rows between unbounded preceding and 1 preceding)""",
    "page_outcome",
)
def sticky_flags(d: Derived) -> DataFrame:
    ctx = resolve.with_ctx(_ladder(d), key="url_key")
    return ctx.select("url_key", "rung", "prev_rungs_empty", "prev_rung_failed")


@query(
    "latest_wins",
    "select run_id, entity_name, event_id, rung, value from rung_event "
    "qualify row_number() over (partition by entity_name order by event_id desc) = 1",
    "rung_event",
)
def latest_wins(d: Derived) -> DataFrame:
    rows = d.rung_event.select("run_id", "entity_name", "event_id", "rung", "value")
    return cache.latest(rows, "entity_name", "event_id")


@query(
    "breaker_open",
    """cum as (select *, sum(case when ok then 0 else 1 end) over w as f, count(*) filter (where ok) over w as island
      from provider_attempt window w as (partition by provider order by ts, event_id rows unbounded preceding)),
    streaks as (select *, case when ok then 0 else row_number() over (partition by provider, island, ok order by ts, event_id) end as streak from cum)
    select event_id, ts, provider, ok, cast(streak as bigint) as streak, not ok and streak % 2 = 0 as opens,
      case when not ok and streak % 2 = 0 then ts + interval '120' second end as open_until from streaks""",
    "provider_attempt",
)
def breaker_open(d: Derived) -> DataFrame:
    return health.breaker(d.provider_attempt.drop("status"))


@query(
    "cooldown_intervals",
    """trips as (select *, ts + interval '3600' second as until from provider_attempt where status in (429, 432, 433)),
    seen as (select *, max(until) over (partition by provider order by ts, event_id rows between unbounded preceding and 1 preceding) as latest from trips),
    isl as (select *, sum(case when latest > ts then 0 else 1 end) over (partition by provider order by ts, event_id rows unbounded preceding) as island from seen)
    select provider, min(ts) as cooling_from, max(until) as cooling_until, count(*) as trips from isl group by provider, island""",
    "provider_attempt",
)
def cooldown_intervals(d: Derived) -> DataFrame:
    return health.cooldowns(d.provider_attempt)


@query(
    "batch_of_20",
    """select url_key, substr(url_key, 1, 1) as batch_bucket, (row_number() over (partition by substr(url_key, 1, 1) order by url_key) - 1) // 20 as batch_no
    from (select distinct url_key from keyed_request)""",
    "keyed_request",
)
def batch_of_20(d: Derived) -> DataFrame:
    return health.assign_batches(with_url_key(d.page_request))


@query(
    "top_cached",
    "select url_key, url, fetch_count from page_cache order by fetch_count desc, url_key limit 10",
    "page_cache",
)
def top_cached(d: Derived) -> DataFrame:
    """A top-ten report."""
    return cache.top_pages(d.page_cache, 10)


@query(
    "pick_one",
    """select lower(company_name) as name, company_name, status, notes from known
    qualify row_number() over (partition by lower(company_name) order by id) = 1""",
    "known",
)
def pick_one(d: Derived) -> DataFrame:
    return accounts.by_name(d.known).select(F.col("_name").alias("name"), "_by_name.*")


@query("input_order", "select pos, name, internal_status from xref order by pos", "xref")
def input_order(d: Derived) -> DataFrame:
    rows = accounts.xref(d.entity, d.known).select("pos", "name", "internal_status")
    return resolve.restore_order(rows)


# --- I: updates ----------------------------------------------------------------------------------


@query(
    "upsert_search",
    f"""w as (select query_key, arg_min_null(alone, req) is null as empty from search_alone where not hit group by query_key)
    select coalesce(o.query_key, w.query_key) as query_key, coalesce(o.query, l.query) as query,
      case when w.query_key is null then o.empty else w.empty end as empty,
      case when w.query_key is null then o.fetched_at else {NOW} end as fetched_at
    from search_cache o full join w on o.query_key = w.query_key
      left join (select query_key, arg_min(query, req) as query from search_alone where not hit group by 1) l on l.query_key = w.query_key""",
    "search_alone search_cache",
)
def upsert_search(d: Derived) -> DataFrame:
    writes = resolve.resolve_search(d.search_request, d.search_outcome, d.search_cache, AS_OF).writes
    return cache.upsert_search(d.search_cache, writes).select("query_key", "query", "empty", "fetched_at")


@query(
    "upsert_telemetry",
    """select run_id, entity_name, orchestrator_turns, tokens_in, tokens_out, credits_spent, round(usd_spent, 6) as usd_spent, cache_hits,
    verified_fields, unverified_fields, entity_domain, internal_status, duration_ms, created_at, n_rungs
    from entity_telemetry join (select run_id, entity_name, count(distinct rung) as n_rungs from delta group by 1, 2) using (run_id, entity_name)""",
    "entity_telemetry delta",
)
def upsert_telemetry(d: Derived) -> DataFrame:
    """The first half of the month as state, the second as deltas: together the whole fold."""
    middle = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    delta = d.telemetry_delta
    state = telemetry.fold_telemetry(delta.where(F.col("created_at") < middle))
    merged = telemetry.upsert_telemetry(state, delta.where(F.col("created_at") >= middle))
    return merged.withColumn("usd_spent", _usd("usd_spent")).withColumn(
        "n_rungs", F.size("rung_hits").cast("long")
    ).drop("rung_hits")


@query(
    "create_runs",
    f"select run_id, model, 'company' as entity_type, 0 as entity_count, 'running' as status, {NOW} as started_at from run",
    "run",
)
def create_runs(d: Derived) -> DataFrame:
    made = telemetry.create_runs(d.run.select("run_id", "model"), AS_OF)
    return made.select("run_id", "model", "entity_type", "entity_count", "status", "started_at")


@query(
    "pause_runs",
    _WATCHDOG
    + """ select run_id, case when paused and status = 'running' then 'paused' else status end as status,
    case when paused and status = 'running' then format('verified-rate {:.2f} < 0.55 over trailing {} entities', rate, entities) end as paused_reason from verdict""",
    "entity_telemetry run",
)
def pause_runs(d: Derived) -> DataFrame:
    after = telemetry.pause_runs(d.run, telemetry.watchdog(d.entity_telemetry, d.run))
    return after.select("run_id", "status", "paused_reason")


@query(
    "uniqueness_check",
    "select url_key, count(*) as rows from page_text group by 1 having count(*) > 1",
    "page_text",
)
def uniqueness_check(d: Derived) -> DataFrame:
    return telemetry.duplicates(d.page_text, ["url_key"])


# --- J: facts --------------------------------------------------------------------------------------


@query(
    "fact_status",
    """select fact_id, case when verified and value <> '' and source_url <> '' then 'verified'
    when not verified and value = '' and starts_with(note, 'NOT FOUND') then 'not_found'
    when not verified and value <> '' and contains(note, 'UNVERIFIED') then 'unverified' else 'violation' end as fact_status from fact""",
    "fact",
)
def fact_status(d: Derived) -> DataFrame:
    return facts.classify_facts(d.fact).select("fact_id", "fact_status")


@query(
    "blank_unverified",
    """select claim_id, case when verified then value else '' end as value, verified,
    case when verified then '' else 'NOT FOUND — searched ' || source_url end as note from checked_claim""",
    "checked_claim",
)
def blank_unverified(d: Derived) -> DataFrame:
    rows = facts.blank_unverified(facts.verify_claims(d.claim, d.page))
    return rows.select("claim_id", "value", "verified", "note")


@query(
    "rows_wide",
    """best as (select * from fact qualify row_number() over (partition by entity_name, field
      order by verified and value <> '' and source_url <> '' desc, source_url, value, verified, note) = 1)
    select entity_name, max(value) filter (where field = 'hq_city') as hq_city, max(source_url) filter (where field = 'hq_city') as hq_city_source,
      max(value) filter (where field = 'employee_count') as employee_count,
      max(source_url) filter (where field = 'employee_count') as employee_count_source,
      max(value) filter (where field = 'ceo') as ceo, max(source_url) filter (where field = 'ceo') as ceo_source from best group by 1""",
    "fact",
)
def rows_wide(d: Derived) -> DataFrame:
    return facts.pivot_facts(d.fact, FIELDS)


_BEST = """best as (select * from fact qualify row_number() over (partition by entity_name, field
      order by verified and value <> '' and source_url <> '' desc, source_url, value, verified, note) = 1),
    one as (select name, min(internal_status) as internal_status, min(internal_ref) as internal_ref, min(internal_note) as internal_note
      from xref group by 1),
    shown as (select entity_name as entity,
      coalesce(max(case when verified then value else '' end) filter (where field = 'hq_city'), '') as hq_city,
      coalesce(max(case when verified then value else '' end) filter (where field = 'employee_count'), '') as employee_count,
      coalesce(max(case when verified then value else '' end) filter (where field = 'ceo'), '') as ceo,
      coalesce(max(nullif(source_url, '')) filter (where field = 'hq_city'), max(nullif(source_url, '')) filter (where field = 'employee_count'),
        max(nullif(source_url, '')) filter (where field = 'ceo'), '') as source_url, bool_and(verified) as verified,
      concat_ws('; ', max(nullif(note, '')) filter (where field = 'hq_city'), max(nullif(note, '')) filter (where field = 'employee_count'),
        max(nullif(note, '')) filter (where field = 'ceo')) as note from best group by 1)"""


@query(
    "output_rows",
    _BEST + " select s.*, o.internal_status, o.internal_ref, o.internal_note from shown s left join one o on o.name = s.entity",
    "fact xref",
)
def output_rows(d: Derived) -> DataFrame:
    """What a job hands out: one row per entity."""
    known = accounts.xref(d.entity, d.known).withColumnRenamed("name", "entity_name")
    return facts.output_rows(d.fact, known, FIELDS)


@query(
    "verified_counts",
    """select run_id, entity_name, count(*) filter (where verified) as verified_fields, count(*) filter (where not verified) as unverified_fields
    from fact group by 1, 2""",
    "fact",
)
def verified_counts(d: Derived) -> DataFrame:
    return telemetry.field_counts(d.fact)


@query(
    "primary_source_pref",
    f"""own as (select entity_name, min({q.canon_domain('domain')}) as own_domain from fact group by 1),
    scored as (select f.*, coalesce({q.canon_domain(q.host('source_url'))} = own_domain, false) as primary_source from fact f left join own using (entity_name))
    select entity_name, field, value, source_url, primary_source from scored
    qualify row_number() over (partition by entity_name, field order by primary_source desc, source_url, value) = 1""",
    "fact",
)
def primary_source_pref(d: Derived) -> DataFrame:
    own = d.fact.groupBy("entity_name").agg(F.min(canon_domain(F.col("domain"))).alias("domain"))
    best = facts.rank_sources(d.fact, own)
    return best.select("entity_name", "field", "value", "source_url", "primary_source")


@query(
    "map_canonical",
    """one as (select name, min(internal_status) as internal_status from xref group by 1),
    picked as (select *, row_number() over (partition by entity_name, field order by source_url, value) as nth from fact where verified)
    select p.entity_name as company_name, min(p.domain) as company_domain,
      max(value) filter (where field = 'hq_city' and nth = 1) as hq_city, max(value) filter (where field = 'ceo' and nth = 1) as ceo,
      string_agg(distinct source_url, '|' order by source_url) as sources, min(one.internal_status) as db_status
    from picked p left join one on one.name = p.entity_name group by 1""",
    "fact xref",
)
def map_canonical(d: Derived) -> DataFrame:
    per_entity = accounts.xref(d.entity, d.known).groupBy(F.col("name").alias("entity_name"))
    per_entity = per_entity.agg(*[F.min(c).alias(c) for c in ("internal_status", "internal_ref", "internal_note")])
    rows = facts.to_canonical(accounts.attach_xref(d.fact, per_entity), FIELDS)
    return rows.select(
        "company_name",
        "company_domain",
        F.try_element_at("intel", F.lit("hq_city")).alias("hq_city"),
        F.try_element_at("intel", F.lit("ceo")).alias("ceo"),
        F.array_join("sources", "|").alias("sources"),
        "db_status",
    )
