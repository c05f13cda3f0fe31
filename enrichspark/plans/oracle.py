"""The derived tables once more, in SQL, for checking queries against another engine."""

from __future__ import annotations

import re

from enrichspark import constants as C
from enrichspark.sources.derived import ANCHOR, AS_OF

NOW = f"timestamp '{AS_OF}'"
LF = "chr(10)"
_SPACES = "' ' || chr(9) || chr(13) || chr(160)"


def strip(x: str) -> str:
    return f"trim({x}, {_SPACES} || {LF})"


def canon_url(u: str) -> str:
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z]+)://', 1))"
    host = f"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1))"
    port = f"case when {scheme} = 'https' then ':443$' else ':80$' end"
    path = f"rtrim(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')"
    tracking = "'^(utm_|(gclid|fbclid|mc_eid|mc_cid|_hsenc|_hsmi)(=|$))'"
    query = (
        f"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), "
        f"lambda x: x <> '' and not regexp_matches(x, {tracking})), '&')"
    )
    return (
        f"({scheme} || '://' || regexp_replace({host}, {port}, '') || coalesce(nullif({path}, ''), '/') "
        f"|| case when {query} = '' then '' else '?' || {query} end)"
    )


def url_key(u: str) -> str:
    return f"sha256({canon_url(u)})"


def canon_query(q: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({q}, '')), '\\s+', ' ', 'g'))"


def query_key(q: str) -> str:
    return f"sha256('search|' || {canon_query(q)})"


def canon_domain(d: str) -> str:
    bare = f"split_part(regexp_replace(lower({strip(d)}), '^https?://', ''), '/', 1)"
    return f"nullif(rtrim(regexp_replace({bare}, '^www\\.', ''), '.'), '')"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '://([^/?#]+)', 1))"


def html_text(h: str) -> str:
    t = f"regexp_replace({h}, '(?s)<!--.*?(-->|\\z)', {LF}, 'g')"
    for tag in C.DROPPED_SUBTREES:
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?(</{tag}\\s*>|\\z)', {LF}, 'g')"
    t = f"regexp_replace({t}, '<[!/?A-Za-z][^>]*>', {LF}, 'g')"
    # No lookahead here: the character after the name is taken along, so neighbours need a second go.
    for _ in range(2):
        names = "lt|gt|quot|nbsp|copy|middot|amp"
        t = f"regexp_replace({t}, '&({names})([^A-Za-z0-9;.-]|\\z)', '&\\1;\\2', 'g')"
    for entity, char in (
        ("&lt;", "'<'"),
        ("&gt;", "'>'"),
        ("&quot;", "'\"'"),
        ("&#39;", "''''"),
        ("&apos;", "''''"),
        ("&nbsp;", "chr(160)"),
        ("&copy;", "'©'"),
        ("&middot;", "'·'"),
        ("&amp;", "'&'"),
    ):
        t = f"replace({t}, '{entity}', {char})"
    lines = f"list_transform(string_split({t}, {LF}), lambda x: {strip('x')})"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), {LF})"


def usable(c: str) -> str:
    body = strip(f"coalesce({c}, '')")
    markers = "|".join(C.SHELL_MARKERS)
    return (
        f"(length({body}) >= 500 and not (length({body}) < 3000 "
        f"and regexp_matches(lower(substr({body}, 1, 4000)), '{markers}')))"
    )


_KIND = "case when page_id % 17 = 0 then 404 when page_id % 17 = 1 then 403 else 200 end"
_HEAD = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_TAIL = "regexp_extract(url, '([?#].*)$', 1)"
_FETCHED = f"cast({NOW} - to_days(cast(page_id % 120 as integer)) as timestamp)"



def _xref(entities: str, columns: str) -> str:
    return f"""
        select {columns}, coalesce(d.status, n.status, 'net-new') as internal_status,
          case when d.id is null and n.id is null then '' else coalesce(d.company_name, n.company_name) end as internal_ref,
          case when d.id is not null then coalesce(d.notes, '{C.MATCH_NOTE}')
            when n.id is not null then coalesce(n.notes, '{C.MATCH_NOTE}') else '' end as internal_note
        from {entities} e
          left join (select * from known where domain_normalized is not null
            qualify row_number() over (partition by domain_normalized order by id) = 1) d
            on d.domain_normalized = {canon_domain('e.domain')}
          left join (select * from known qualify row_number() over (partition by lower(company_name) order by id) = 1) n
            on lower(n.company_name) = lower(e.name)"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "rung_event": (
        (),
        """
        select event_id, user_id % 6 as run_id, concat('entity_', cast(user_id as varchar)) as entity_name,
          event_type, value, props, ts,
          case when event_id % 10 = 0 then 'fetch' when event_type in ('click','error') then 'search' else 'fetch' end as waterfall,
          case when event_id % 10 = 0 then 'cache' when event_type='view' then 'native' when event_type='click' then 'keyword'
               when event_type='signup' then 'jina' when event_type='purchase' then 'tavily' else 'parallel' end as rung,
          case when event_id % 10 = 0 or event_type in ('view','click','signup') then 'free'
               when event_type='purchase' then 'credit' else 'gated' end as tier,
          (event_id % 10 = 0 or value >= 15) as success, (event_id % 10 = 0) as from_cache,
          cast(floor(value*10) as int) as latency_ms,
          case when event_id % 10 <> 0 and event_type='purchase' and value >= 15 then 1 else 0 end as cost_credits,
          case when event_id % 10 <> 0 and event_type='error' and value >= 15 then 0.005 else 0.0 end as cost_usd
        from events""",
    ),
    "delta": (
        ("rung_event",),
        """
        select run_id, entity_name, event_id as seq, ts as created_at, latency_ms as tokens_in,
          length(props) as tokens_out, cost_credits, cost_usd, from_cache, rung,
          case when event_type = 'purchase' or (run_id < 3 and event_type = 'signup') then 1 else 0 end as v,
          case when event_type = 'error' then 1 else 0 end as u,
          case when event_type in ('view','click') then concat('d', cast(event_id % 3 as varchar)) end as entity_domain,
          case when event_type = 'signup' then 'customer' when event_type = 'purchase' then 'net-new' end as internal_status,
          case when value >= 50 then latency_ms end as duration_ms
        from rung_event""",
    ),
    "entity_telemetry": (
        ("delta",),
        """
        select run_id, entity_name, count(*) as orchestrator_turns, cast(sum(tokens_in) as bigint) as tokens_in,
          cast(sum(tokens_out) as bigint) as tokens_out, cast(sum(cost_credits) as bigint) as credits_spent,
          sum(cost_usd) as usd_spent, cast(sum(case when from_cache then 1 else 0 end) as bigint) as cache_hits,
          cast(sum(v) as bigint) as verified_fields, cast(sum(u) as bigint) as unverified_fields,
          arg_max(entity_domain, seq) filter (where entity_domain is not null) as entity_domain,
          arg_max(internal_status, seq) filter (where internal_status is not null) as internal_status,
          cast(arg_max(duration_ms, seq) filter (where duration_ms is not null) as bigint) as duration_ms,
          min(created_at) as created_at
        from delta group by run_id, entity_name""",
    ),
    "run": (
        ("rung_event",),
        """
        select run_id, case when run_id % 2 = 0 then 'sonnet' else 'haiku' end as model,
          case when run_id = 5 then 'done' else 'running' end as status
        from (select distinct run_id from rung_event union all select 99)""",
    ),
    "provider_attempt": (
        (),
        """
        select event_id, ts, event_type as provider, value >= 15 as ok,
          case when value < 5 then 429 when value < 8 then 432 when value < 15 then 500 else 200 end as status
        from events""",
    ),
    "page_core": (
        (),
        f"""
        select page_id, url, http_status, http_status = 404 as is_dead, fetched_at,
          fetched_at + case when http_status = 404 then interval '90' day else interval '30' day end as expires_at
        from (select page_id, url, {_KIND} as http_status, {_FETCHED} as fetched_at from pages)""",
    ),
    "page_text": (
        (),
        f"""
        select page_id, url, {host('url')} as host, {url_key('url')} as url_key, {_KIND} as http_status,
          {html_text('html')} as content
        from pages""",
    ),
    "page": (
        ("page_text",),
        "select * from page_text qualify row_number() over (partition by url_key order by page_id desc) = 1",
    ),
    "page_cache": (
        ("page",),
        f"""
        select *, sha256(coalesce(nullif(digest, ''), nullif(raw_excerpt, ''), '')) as content_hash,
          fetched_at + case when is_dead then interval '90' day else interval '30' day end as expires_at
        from (select url_key, url, http_status, http_status = 404 as is_dead,
          case when http_status = 404 or page_id % 3 = 0 then 'native' when page_id % 3 = 1 then 'jina' else 'tavily' end as provider,
          case when http_status <> 404 and page_id % 4 = 1 then concat('digest of ', url) end as digest,
          case when http_status <> 404 and page_id % 4 <> 1
            then case when page_id % 13 = 5 then '' else substr(content, 1, 4000) end end as raw_excerpt,
          {_FETCHED} as fetched_at, page_id % 5 + 1 as fetch_count
        from page)""",
    ),
    "live": (("page_cache",), f"select * from page_cache where expires_at > {NOW}"),
    "page_request": (
        (),
        f"""
        select page_id * 10 + v as req, page_id % 6 as run_id, {host('base')} as entity_name,
          case v when 0 then base when 1 then upper(head) || path || tail
            when 2 then head || case when starts_with(base, 'https') then ':443' else ':80' end || path || tail
            when 3 then head || path || '/' || tail
            when 4 then head || path || case when starts_with(tail, '?') then '?utm_x=1&' || substr(tail, 2) else '?utm_x=1' || tail end
            when 5 then base || '#part' else head || '/missing/' || cast(page_id as varchar) end as url,
          (page_id + v) % 2 = 0 as allow_parallel, (page_id + v) % 5 = 0 as cooling
        from (select page_id, url as base, {_HEAD} as head, {_PATH} as path, {_TAIL} as tail, unnest(range(7)) as v from pages)""",
    ),
    "keyed_request": (("page_request",), f"select *, {url_key('url')} as url_key from page_request"),
    "page_outcome": (
        ("page",),
        """
        select url_key, 'native' as rung, http_status = 200 as ok, http_status as status, page_id % 100 + 1 as latency_ms,
          case when http_status <> 200 or page_id % 5 = 0 then ''
            when page_id % 7 = 0 then 'Please enable JavaScript to continue.' else content end as content from page
        union all select url_key, 'jina', page_id % 3 <> 0, case when page_id % 3 <> 0 then 200 else 500 end, page_id % 100 + 2,
          case when page_id % 3 <> 0 then content else '' end from page
        union all select url_key, 'tavily', page_id % 4 <> 0,
          case when page_id % 4 <> 0 then 200 when page_id % 8 = 0 then 429 else 500 end, page_id % 100 + 3,
          case when page_id % 4 <> 0 then content else '' end from page
        union all select url_key, 'parallel', true, 200, page_id % 100 + 4, content from page""",
    ),
    # Each page outcome judged by its rung's own length rule, one row per page.
    "page_flags": (
        ("page_outcome",),
        f"""
        select url_key,
          bool_or(rung = 'native' and ok and {usable('content')}) as native_ok,
          max(case when rung = 'native' then status end) as native_status,
          bool_or(rung = 'native' and ok) as native_answered,
          bool_or(rung = 'native' and {strip('content')} <> '') as native_text,
          bool_or(rung = 'jina' and ok and length({strip('content')}) >= 500) as jina_ok,
          bool_or(rung = 'tavily' and ok and content <> '') as tavily_ok,
          bool_or(rung = 'tavily' and status in (429, 432, 433)) as tavily_limited,
          max(case when rung = 'tavily' then status end) as tavily_status,
          bool_or(rung = 'parallel' and ok and length({strip('content')}) >= 200) as parallel_ok,
          max(case when rung = 'native' then latency_ms end) as base_ms
        from page_outcome group by url_key""",
    ),
    # What each request would get on its own, then who leads and who follows per key.
    "fetch_alone": (
        ("keyed_request", "page_flags", "live"),
        """
        select r.*, web and c.url_key is not null as hit, c.is_dead as cached_dead, c.http_status as cached_status,
          coalesce(nullif(c.digest, ''), nullif(c.raw_excerpt, ''), '') <> '' as cached_ok,
          f.native_status, f.base_ms, coalesce(f.native_text, false) as native_text,
          case when f.native_ok then 'native' when f.native_status in (401, 404, 410) then 'dead'
            when f.jina_ok then 'jina' when f.tavily_ok and not r.cooling then 'tavily'
            when r.allow_parallel and f.parallel_ok then 'parallel'
            when f.native_text then 'native-thin' else 'failed' end as alone
        from (select *, starts_with(url, 'http://') or starts_with(url, 'https://') as web from keyed_request) r left join page_flags f using (url_key) left join live c using (url_key)""",
    ),
    "fetch_lead": (
        ("fetch_alone",),
        """
        select url_key, min(req) as lead_req, arg_min(alone, req) as lead_tier, arg_min(native_status, req) as lead_status
        from fetch_alone where web and not hit and alone not in ('native-thin', 'failed') group by url_key""",
    ),
    "fetched": (
        ("fetch_alone", "fetch_lead"),
        """
        select *, hit or follows as from_cache,
          case when not web then 'missing' when hit then case when cached_dead then 'dead' else 'cache' end
            when follows then case when lead_tier = 'dead' then 'dead' else 'cache' end else alone end as tier
        from (select a.*, l.lead_req, l.lead_tier, l.lead_status, coalesce(a.web and not a.hit and a.req > l.lead_req, false) as follows
          from fetch_alone a left join fetch_lead l using (url_key))""",
    ),
    "fetch_resolved": (
        ("fetched",),
        """
        select req, run_id, entity_name, url_key, url, tier, from_cache,
          case when hit then not cached_dead and cached_ok else tier not in ('dead', 'failed', 'missing') end as ok,
          cast(case when hit then cached_status
            when follows then case when lead_tier in ('dead', 'native') then lead_status else 200 end
            when tier in ('dead', 'native') then native_status
            when tier in ('jina', 'tavily', 'parallel') then 200 end as integer) as status,
          cast(case when tier = 'tavily' and not from_cache then 1 else 0 end as bigint) as credits,
          case when hit then null when follows then case when lead_tier = 'dead' then null else lead_tier end
            when tier = 'native-thin' then 'native' when tier in ('dead', 'failed', 'missing') then null else tier end as content_rung,
          case when tier = 'dead' then 'dead URL (HTTP ' || cast(case when hit then cached_status when follows then lead_status else native_status end as varchar)
              || case when from_cache then ') — re-search' else ') — re-search, do not retry' end
            when tier = 'native-thin' then 'thin native body; escalation rungs could not improve it'
            when tier = 'missing' then 'not a URL and not a file'
            when tier = 'failed' then 'no usable content' end as error
        from fetched""",
    ),
    "fetch_event": (
        ("fetched",),
        """
        select req, 'cache' as rung, 'free' as tier, true as success, true as from_cache,
          cast(null as bigint) as latency_ms, 0 as cost_credits, 0.0 as cost_usd from fetched where from_cache
        union all select req, 'native', 'free', alone = 'native', false, base_ms, 0, 0.0 from fetched where web and not from_cache
        union all select req, 'jina', 'free', alone = 'jina', false, base_ms + 1, 0, 0.0 from fetched
          where web and not from_cache and alone not in ('native', 'dead')
        union all select req, 'tavily', 'credit', alone = 'tavily', false, case when not cooling then base_ms + 2 end, case when alone = 'tavily' then 1 else 0 end, 0.0
          from fetched where web and not from_cache and alone not in ('native', 'dead', 'jina')
        union all select req, 'parallel', 'gated', alone = 'parallel', false, base_ms + 3, 0, case when alone = 'parallel' then 0.005 else 0.0 end
          from fetched where web and not from_cache and allow_parallel and alone in ('parallel', 'native-thin', 'failed')""",
    ),
    "fetch_content": (
        ("fetch_resolved", "page_outcome", "page_cache"),
        """
        select r.*, case when r.tier = 'dead' then ''
            when r.from_cache and r.content_rung is null then coalesce(nullif(c.digest, ''), nullif(c.raw_excerpt, ''), '')
            when r.from_cache then substr(o.content, 1, 4000) else coalesce(o.content, '') end as content
        from fetch_resolved r left join page_outcome o on o.url_key = r.url_key and o.rung = r.content_rung
          left join page_cache c on c.url_key = r.url_key""",
    ),
    "fetch_write": (
        ("fetch_lead", "keyed_request", "page_outcome"),
        f"""
        select l.url_key, q.url, cast(case when l.lead_tier in ('dead', 'native') then l.lead_status else 200 end as integer) as http_status,
          l.lead_tier = 'dead' as is_dead, case when l.lead_tier = 'dead' then 'native' else l.lead_tier end as provider,
          cast(null as varchar) as digest, case when l.lead_tier <> 'dead' then substr(o.content, 1, 4000) end as raw_excerpt,
          {NOW} as fetched_at, 1 as fetch_count,
          {NOW} + case when l.lead_tier = 'dead' then interval '90' day else interval '30' day end as expires_at
        from fetch_lead l join keyed_request q on q.req = l.lead_req
          left join page_outcome o on o.url_key = l.url_key and o.rung = l.lead_tier""",
    ),
    "page_cache_after": (
        ("page_cache", "fetch_write"),
        """
        select coalesce(o.url_key, n.url_key) as url_key, coalesce(o.url, n.url) as url,
          case when n.url_key is null then o.http_status else n.http_status end as http_status,
          case when n.url_key is null then o.is_dead else n.is_dead end as is_dead,
          case when n.url_key is null then o.provider else n.provider end as provider,
          case when n.url_key is null then o.digest else n.digest end as digest,
          case when n.url_key is null then o.raw_excerpt else n.raw_excerpt end as raw_excerpt,
          case when n.url_key is null then o.fetched_at else n.fetched_at end as fetched_at,
          case when n.url_key is null then o.expires_at else n.expires_at end as expires_at,
          coalesce(o.fetch_count, n.fetch_count) as fetch_count
        from page_cache o full join fetch_write n on o.url_key = n.url_key""",
    ),
    "search_request": (
        (),
        f"""
        select (conv_id * 1000 + turn) * 3 + v as req, conv_id % 6 as run_id, concat('conv_', cast(conv_id as varchar)) as entity_name,
          case v when 0 then text when 1 then lower(text) else '  ' || replace(text, ' ', '  ') || {LF} end as query,
          case when conv_id % 2 = 0 then 'semantic' else 'keyword' end as query_intent, conv_id % 3 = 0 as allow_parallel
        from (select *, unnest(range(3)) as v from conversations where role = 'user')""",
    ),
    "keyed_search": (("search_request",), f"select *, {query_key('query')} as query_key from search_request"),
    "search_key": (
        (),
        f"""
        select {query_key('text')} as query_key, min(conv_id) as cid, min({canon_query('text')}) as query
        from conversations where role = 'user' group by 1""",
    ),
    "search_flags": (
        ("search_key",),
        """
        select *, cid % 5 >= 3 as keyword_ok, cid % 3 <> 0 as exa_ok, cid % 4 >= 2 as tavily_ok, cid % 9 <> 0 as parallel_ok
        from search_key""",
    ),
    "search_cache": (
        ("search_key",),
        f"""
        select query_key, query, 'search' as rung, cid, cid % 5 < 3 as empty,
          cast({NOW} - to_days(cast(cid % 60 as integer)) as timestamp) as fetched_at,
          cast({NOW} - to_days(cast(cid % 60 as integer)) as timestamp) + interval '30' day as expires_at
        from search_key where cid % 3 = 2""",
    ),
    "search_alone": (
        ("keyed_search", "search_flags", "search_cache"),
        f"""
        select r.*, f.cid, f.query as canon, c.query_key is not null as hit, c.empty as cached_empty,
          case when keyword_ok then 'keyword' when query_intent = 'semantic' and exa_ok then 'exa'
            when tavily_ok then 'tavily' when r.allow_parallel and parallel_ok then 'parallel' end as alone
        from keyed_search r left join search_flags f using (query_key)
          left join (select * from search_cache where expires_at > {NOW}) c using (query_key)""",
    ),
    "searched": (
        ("search_alone",),
        """
        select a.*, l.lead_req, l.lead_rung, not a.hit and a.req > l.lead_req as follows,
          a.hit or coalesce(a.req > l.lead_req, false) as from_cache
        from search_alone a left join (select query_key, min(req) as lead_req, arg_min_null(alone, req) as lead_rung
          from search_alone where not hit group by query_key) l using (query_key)""",
    ),
    "search_resolved": (
        ("searched",),
        """
        select req, run_id, entity_name, query_key, from_cache,
          case when from_cache then 'cache' when alone = 'keyword' then
            case cid % 4 when 0 then 'ddg' when 1 then 'brave' when 2 then 'claude_cli' else 'serper' end
            else coalesce(alone, 'none') end as provider,
          case when hit then not cached_empty when follows then lead_rung is not null else alone is not null end as ok,
          cast(case when not from_cache and alone = 'tavily' then 1 else 0 end as bigint) as credits,
          case when hit then null when follows then lead_rung else alone end as result_rung
        from searched""",
    ),
    "entity": (
        (),
        f"""
        select page_id as pos, regexp_extract({host('url')}, '([^.]+)\\.example\\.', 1) as name,
          case when page_id % 10 <> 9 then url end as domain from pages""",
    ),
    "known": (
        (),
        f"""
        select *, {canon_domain('domain')} as domain_normalized from (
          select id, upper(regexp_extract(host, '([^.]+)\\.example\\.', 1)) as company_name,
            case when length(host) % 4 <> 0 then 'https://' || host || '/' end as domain,
            case length(host) % 3 when 0 then 'customer' when 1 then 'prior-prospect' else 'do-not-contact' end as status,
            case when id % 2 = 0 then 'note ' || host end as notes
          from (select {host('url')} as host, min(page_id) as id from pages group by 1)
          where length(host) % 4 <> 0 or id % 2 = 0)""",
    ),
    "xref": (("entity", "known"), _xref("entity", "e.pos, e.name, e.domain")),
    "host_entity": (
        (),
        f"""
        select {host('url')} as entity_name, regexp_extract({host('url')}, '([^.]+)\\.example\\.', 1) as name,
          {host('url')} as domain, min(page_id) as pos from pages group by 1""",
    ),
    "host_xref": (("host_entity", "known"), _xref("host_entity", "e.entity_name")),
    "claim": (
        ("page",),
        """
        select page_id as claim_id, page_id % 6 as run_id, host as entity_name,
          case page_id % 3 when 0 then 'hq_city' when 1 then 'employee_count' else 'ceo' end as field,
          concat('v', cast(page_id as varchar)) as value, content, url_key,
          case when page_id % 4 = 0 then said || ' zz' else said end as quote, url || '#cited' as source_url
        from (select *, substr(content, 1 + page_id * 37 % greatest(length(content) - 60, 1), 60) as said from page)""",
    ),
    "checked_claim": (
        ("claim",),
        """
        select *, contains(trim(regexp_replace(lower(content), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g')))
          and quote <> '' as verified
        from claim""",
    ),
    "fact": (
        (),
        f"""
        select page_id as fact_id, page_id % 6 as run_id, regexp_extract({host('url')}, '([^.]+)\\.example\\.', 1) as entity_name,
          {host('url')} as domain,
          case page_id % 3 when 0 then 'hq_city' when 1 then 'employee_count' else 'ceo' end as field,
          case when page_id % 8 = 0 then '' else concat('v', cast(page_id % 2 as varchar)) end as value,
          case when page_id % 8 = 2 then '' else url end as source_url, page_id % 8 >= 2 as verified,
          case when page_id % 8 = 0 then concat('NOT FOUND — searched ', url) when page_id % 8 = 1 then 'UNVERIFIED guess' else '' end as note
        from pages""",
    ),
    "anchor": (
        (),
        f"""
        select page_id, unnest(range(1, len(hrefs) + 1)) as nth, unnest(hrefs) as href, unnest(labels) as label
        from (select page_id, regexp_extract_all(html, '{ANCHOR}', 1) as hrefs, regexp_extract_all(html, '{ANCHOR}', 2) as labels
          from pages)""",
    ),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the derived tables it needs, each defined once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    heads = [f"{name} as ({CTES[name][1]})" for name in order]
    if not heads:
        return body
    # A body may open with tables of its own.
    own = re.match(r"\s*\w+ as \(", body)
    return f"with {', '.join(heads)}{', ' if own else ' '}{body}"
