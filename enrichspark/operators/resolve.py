"""First-success resolution of searches and page fetches over stored outcomes.

Requests are folded to one row per key and set of clearances before anything is joined, so a key
asked for by a third of all requests is decided once. Only flags travel through the decision;
page text is joined to winners afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import cached_body, url_host, with_query_key, with_url_key
from enrichspark.functions.payloads import RESULT_TYPE
from enrichspark.functions.policy import (
    DEFAULT_POLICY,
    LOGS_WHEN_UNAVAILABLE,
    Rung,
    gate_col,
    is_configured,
    policy_col,
    rungs,
)
from enrichspark.functions.text import body_length, excerpt, is_dead, long_enough, needs_digest, truncated, usable
from enrichspark.operators.cache import PAGE_KEY, SEARCH_KEY, live, page_writes
from enrichspark.operators.ordered import SLICE_ROWS, numbered
from enrichspark.operators.telemetry import at
from enrichspark.session import cut_lineage

ALL_KEYS = ("exa", "tavily", "parallel", "brave", "serper", "claude_cli")
_FLAG_DEFAULTS = {"query_intent": "keyword", "cooling": False, "user_invocation": False, "domain_list": ""}


class Resolution:
    """``resolved``: one row per request; ``events``: one per attempt; ``writes``: cache rows; ``uses``: requests served
    from the cache per page, those that follow a fetch of the same job included.

    Each is planned when first asked for.
    """

    def __init__(
        self,
        resolved: Callable[[], DataFrame],
        events: Callable[[], DataFrame],
        writes: Callable[[], DataFrame],
        uses: Callable[[], DataFrame] | None = None,
    ):
        self._resolved, self._events, self._writes, self._uses = resolved, events, writes, uses

    @cached_property
    def resolved(self) -> DataFrame:
        return self._resolved()

    @cached_property
    def events(self) -> DataFrame:
        return self._events()

    @cached_property
    def writes(self) -> DataFrame:
        return self._writes()

    @cached_property
    def uses(self) -> DataFrame | None:
        return self._uses() if self._uses else None


# --- building blocks -----------------------------------------------------------


def first_success(outcomes: DataFrame, key: str, ordinal: str = "ordinal", ok: str = "ok") -> DataFrame:
    """Lowest successful position per key, NULL where all failed."""
    return outcomes.groupBy(key).agg(
        F.min(F.when(F.col(ok), F.col(ordinal))).alias("winner"), F.count(F.lit(1)).alias("offered")
    )


def with_ctx(attempts: DataFrame, key: str = "req", ordinal: str = "ordinal", ok: str = "ok") -> DataFrame:
    """State before each attempt of a request. A failure, once seen, stays seen. A request has
    one attempt per rung, so a group is never larger than the policy."""
    before = Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumns(
        {
            "prev_rungs_empty": ~F.coalesce(F.max(ok).over(before), F.lit(False)),
            "prev_rung_failed": F.coalesce(F.max(~F.col(ok)).over(before), F.lit(False)),
        }
    )


def pending_split(pending: DataFrame, outcomes: DataFrame, rung: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests a rung settles, and those left for the next one."""
    won = outcomes.where((F.col("rung") == rung) & F.col("ok")).select(key)
    return pending.join(won, key, "left_semi"), pending.join(won, key, "left_anti")


def restore_order(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Input order, for the sink only."""
    return df.orderBy(pos)


def fetch_flags(outcomes: DataFrame) -> DataFrame:
    """What the decision needs to know of each page outcome, without its text."""
    body, rung, ok = F.col("content"), F.col("rung"), F.col("ok")
    good = (
        F.when(rung == "native", ok & usable(body))
        .when(rung == "jina", ok & long_enough(body, C.READER_MIN_CHARS))
        .when(rung == "parallel", ok & long_enough(body, C.EXTRACT_MIN_CHARS))
        .otherwise(ok & (F.coalesce(body, F.lit("")) != ""))
    )
    return outcomes.select(
        PAGE_KEY,
        "rung",
        F.coalesce(good, F.lit(False)).alias("success"),
        F.col("status").cast("int").alias("status"),
        (body_length(body) > 0).alias("has_text"),
        F.coalesce(ok, F.lit(False)).alias("answered"),
        F.col("latency_ms").cast("long").alias("latency_ms"),
    )


def search_flags(outcomes: DataFrame) -> DataFrame:
    engine = F.col("engine") if "engine" in outcomes.columns else F.lit(None).cast("string")
    return outcomes.select(
        SEARCH_KEY,
        "rung",
        engine.alias("engine"),
        (F.size("results") > 0).alias("success"),
        F.col("latency_ms").cast("long").alias("latency_ms"),
    )


def _by_rung(flags: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row per key with ``<rung>_<flag>`` columns; plain maxima, so Spark combines them
    ahead of the shuffle."""
    cols = [c for c in flags.columns if c not in (key, "rung")]
    return flags.where(F.col("rung").isin(*names)).groupBy(key).agg(
        *[F.max(F.when(F.col("rung") == r, F.col(c))).alias(f"{r}_{c}") for r in names for c in cols]
    )


def _truth(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _attempt(r: Rung, ran: Column, success: Column) -> Column:
    """An attempt as it is logged; a rung that was not able to run has no latency."""
    return F.struct(
        F.lit(r.rung).alias("rung"),
        F.lit(r.tier).alias("tier"),
        success.alias("success"),
        F.lit(False).alias("from_cache"),
        F.when(ran, F.col(f"{r.rung}_latency_ms")).alias("latency_ms"),
        F.when(success, r.credits).otherwise(0).cast("long").alias("cost_credits"),
        F.when(success, F.lit(r.usd)).otherwise(F.lit(0.0)).cast("decimal(18,6)").alias("cost_usd"),
    )


def _walk(
    df: DataFrame, ladder: Sequence[Rung], configured: Iterable[str], fetch: bool, flags: Sequence[str]
) -> DataFrame:
    """Go down the rungs in order, adding ``winner``, ``dead`` and the attempts made."""
    allowed = {c.removeprefix("allow_"): F.col(c) for c in flags if c.startswith("allow_")}
    user = F.col("user_invocation") if "user_invocation" in flags else None
    intent = F.col("query_intent") if "query_intent" in flags else F.lit("keyword")
    keys = set(configured)
    attempts: list[Column] = []
    df = df.withColumns(
        {
            "winner": F.lit(None).cast("string"),
            "dead": F.lit(False),
            "_failed": F.lit(False),
            "_shell": F.lit(False),
        }
    )
    for r in ladder:
        open_ = F.col("winner").isNull() & ~F.col("dead")
        if fetch:
            open_ = open_ & ~F.col("_local")
        if fetch:
            ctx = {"prev_rung_failed": F.col("_failed"), "is_js_shell": F.col("_shell")}
        else:
            ctx = {"prev_rungs_empty": F.col("winner").isNull(), "query_intent": intent}
        # The plain fetch runs whatever the policy says about it.
        fires = F.lit(True) if fetch and r.rung == "native" else policy_col(r.invoke_when, ctx)
        tried = open_ & fires & gate_col(r, allowed, user)
        able = F.lit(is_configured(r.rung, keys))
        if r.rung in LOGS_WHEN_UNAVAILABLE and "cooling" in flags:
            able = able & ~F.col("cooling")
        logged = tried if r.rung in LOGS_WHEN_UNAVAILABLE else tried & able
        success = tried & able & _truth(f"{r.rung}_success")
        step = {f"_tried_{r.rung}": logged, f"_won_{r.rung}": success, f"_tried_able_{r.rung}": tried & able}
        if fetch and r.rung == "native":
            step["_dead_native"] = tried & ~success & is_dead(F.col("native_status"))
            step["_shell_native"] = tried & _truth("native_has_text")
        df = df.withColumns({**step, "_tried": tried})
        won = F.col(f"_won_{r.rung}")
        after = {
            "winner": F.when(won, F.lit(r.rung)).otherwise(F.col("winner")),
            "_failed": F.col("_failed") | (F.col("_tried") & ~won),
        }
        if fetch and r.rung == "native":
            after["dead"] = F.col("_dead_native")
            after["_shell"] = F.col("_shell_native") & ~won
        df = df.withColumns(after)
        attempts.append(F.when(F.col(f"_tried_{r.rung}"), _attempt(r, F.col(f"_tried_able_{r.rung}"), won)))
    spent = {r.rung: r.credits for r in ladder if r.credits}
    credits = F.lit(0)
    for name, n in spent.items():
        credits = F.when(F.col("winner") == name, n).otherwise(credits)
    return df.withColumns(
        {"attempts": F.array_compact(F.array(*attempts)), "credits": credits.cast("long")}
    )


def _cache_event() -> Column:
    return F.array(
        F.struct(
            F.lit("cache").alias("rung"),
            F.lit("free").alias("tier"),
            F.lit(True).alias("success"),
            F.lit(True).alias("from_cache"),
            F.lit(None).cast("long").alias("latency_ms"),
            F.lit(0).cast("long").alias("cost_credits"),
            F.lit(0).cast("decimal(18,6)").alias("cost_usd"),
        )
    )


def _keyed(requests: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests with their key; one stored with the requests is taken as it is."""
    return requests if key in requests.columns else build(requests)


def _flag_columns(requests: DataFrame, ladder: Sequence[Rung]) -> list[str]:
    names = [f"allow_{g}" for g in sorted({"parallel", *(r.gate for r in ladder if r.gate)})]
    return [c for c in (*_FLAG_DEFAULTS, *names) if c in requests.columns]


def _settle(
    requests: DataFrame,
    key: str,
    entries: DataFrame,
    flags_by_rung: DataFrame,
    ladder: Sequence[Rung],
    configured: Iterable[str],
    fetch: bool,
    by_list: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Decide every (key, clearances) once, and find per key the request that fills the cache.

    Requests of one key are served in the order of ``req``: the first whose result is stored
    leads, later ones are cache hits, earlier ones stand alone. ``by_list`` says where the paid search has
    results within a list of domains.
    """
    flags = _flag_columns(requests, ladder)
    asked = requests.withColumns(
        {c: F.coalesce(F.col(c), F.lit(_FLAG_DEFAULTS.get(c, False))) for c in flags}
    )
    if fetch:
        # Anything that does not begin as a lower-case web address is a file or nothing; it neither
        # probes nor asks.
        web = F.coalesce(F.col("url").startswith("http://") | F.col("url").startswith("https://"), F.lit(False))
        asked, flags = asked.withColumn("_local", ~web), [*flags, "_local"]
    text = "url" if fetch else "query"
    variants = asked.groupBy(key, *flags).agg(F.min("req").alias("_first"), F.min_by(text, "req").alias("_text"))
    probed = variants.join(entries, key, "left").join(flags_by_rung, key, "left")
    if by_list is not None:
        probed = probed.join(by_list, [key, "domain_list"], "left")
        within = F.when(F.col("domain_list") != "", _truth("_within")).otherwise(F.col("tavily_success"))
        probed = probed.withColumn("tavily_success", within).drop("_within")
    decided = _walk(probed, ladder, configured, fetch, flags)
    decided = decided.withColumn("hit", _truth("hit") & ~F.col("_local") if fetch else _truth("hit"))
    stored = (F.col("winner").isNotNull() | F.col("dead")) if fetch else F.lit(True)
    # Structs compare by their first field, so the least one is the first request's.
    more = ["native_status"] if fetch else ["domain_list"] if by_list is not None else []
    lead = F.struct("_first", "winner", "dead", "_text", *more)
    # A key has one row per set of clearances here, never one per request.
    of_key = Window.partitionBy(key)
    decided = decided.withColumn("_lead", F.min(F.when(~F.col("hit") & stored, lead)).over(of_key))
    keep = [c for c in decided.columns if not c.startswith(("_tried", "_won", "_dead", "_shell", "_failed"))]
    keep = [c for c in keep if c not in flags_by_rung.columns or c in (key, "native_has_text", "native_status", "keyword_engine")]
    decided = decided.select(*keep)
    leaders = decided.where(F.col("_first") == F.col("_lead._first")).select(key, "_lead")
    return asked.join(decided.drop("_text"), [key, *flags]), leaders


def _events(rows: DataFrame, waterfall: str, as_of: str) -> DataFrame:
    tried = F.when(F.col("from_cache"), _cache_event()).otherwise(F.col("attempts"))
    return rows.select(
        "req", "run_id", "entity_name", F.lit(waterfall).alias("waterfall"), F.inline(tried), at(as_of).alias("ts")
    )


# --- search ----------------------------------------------------------------------


def _suffixes(host: Column) -> Column:
    """A host and all domains it lies in: a.b.com gives a.b.com, b.com, com."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def results_within(outcomes: DataFrame, wanted: DataFrame, domains: DataFrame, rung: str = "tavily") -> DataFrame:
    """``(query_key, domain_list, results)`` of a rung's results that each list in ``wanted(query_key, domain_list)`` lets
    through, in their order; without a row where none is left.

    ``domains(domain_list, domain, excluded)`` may hold any number of lists of any length: results meet domains by an
    equi-join on every suffix of their host. A list that includes domains lets only these and their subdomains through;
    excluded ones never pass.
    """
    listed = domains.select("domain_list", F.lower("domain").alias("_domain"), F.coalesce("excluded", F.lit(False)).alias("_out"))
    listed = listed.groupBy("domain_list", "_domain").agg(F.max("_out").alias("_out"))
    includes = listed.groupBy("domain_list").agg(F.bool_or(~F.col("_out")).alias("_includes"))
    named = wanted.where(F.col("domain_list") != "").distinct()
    asked = named.join(includes, "domain_list", "left")
    found = outcomes.where(F.col("rung") == rung).select(SEARCH_KEY, F.posexplode("results").alias("_pos", "_result"))
    rows = found.join(asked, SEARCH_KEY).withColumn("_host", F.coalesce(url_host(F.col("_result.url")), F.lit("")))
    reached = rows.select(SEARCH_KEY, "domain_list", "_pos", F.explode(_suffixes(F.col("_host"))).alias("_domain"))
    reached = reached.join(listed, ["domain_list", "_domain"]).groupBy(SEARCH_KEY, "domain_list", "_pos")
    reached = reached.agg(F.bool_or(~F.col("_out")).alias("_in"), F.bool_or("_out").alias("_out"))
    judged = rows.join(reached, [SEARCH_KEY, "domain_list", "_pos"], "left")
    kept = judged.where((~_truth("_includes") | _truth("_in")) & ~_truth("_out"))
    # a result list is as long as a search answer
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_result")))
    return kept.groupBy(SEARCH_KEY, "domain_list").agg(F.transform(ordered, lambda x: x["_result"]).alias("results"))


def _answers(outcomes: DataFrame, within: DataFrame | None) -> DataFrame:
    """Result lists by key, rung and the domain list they were asked for with (none: empty)."""
    rows = outcomes.select(SEARCH_KEY, F.col("rung").alias("_rung"), F.lit("").alias("_list"), "results")
    if within is None:
        return rows
    paid = within.select(SEARCH_KEY, F.lit("tavily").alias("_rung"), F.col("domain_list").alias("_list"), "results")
    return rows.unionByName(paid)


def resolve_search(
    requests: DataFrame,
    outcomes: DataFrame,
    cache: DataFrame,
    as_of: str,
    policy: Iterable[Rung] = DEFAULT_POLICY,
    configured: Iterable[str] = ALL_KEYS,
    n: int = C.SEARCH_JOB_RESULTS,
    domains: DataFrame | None = None,
) -> Resolution:
    """``requests(req, run_id, entity_name, query[, query_intent, allow_parallel, domain_list])`` against
    ``outcomes(query_key, rung, results, latency_ms[, engine])`` and the search cache.

    The provider of a keyword answer is the free engine that gave it, where outcomes name one. A
    result, empty or not, is stored for the whole time to live, its first ``n`` rows at most. Requests may name a list in
    ``domains(domain_list, domain, excluded)``: the paid search then gives what lies within it, and gives nothing if that
    is nothing. The cache does not know of lists, so later requests get what the first one stored.
    """
    ladder = rungs("search", policy)
    keyed = _keyed(requests, SEARCH_KEY, with_query_key)
    entries = live(cache, as_of).select(SEARCH_KEY, F.lit(True).alias("hit"), (~F.col("empty")).alias("cached_ok"))
    flags = _by_rung(search_flags(outcomes), SEARCH_KEY, [r.rung for r in ladder])
    within = by_list = None
    if domains is not None:
        within = results_within(outcomes, keyed.select(SEARCH_KEY, "domain_list"), domains)
        by_list = within.select(SEARCH_KEY, "domain_list", F.lit(True).alias("_within"))
    rows, leaders = _settle(keyed, SEARCH_KEY, entries, flags, ladder, configured, False, by_list)

    follows = ~F.col("hit") & (F.col("req") > F.col("_lead._first"))
    rows = rows.withColumn("from_cache", F.col("hit") | follows)
    # Whoever fills the cache settles the result for those that follow.
    source = F.when(follows, F.col("_lead.winner")).when(~F.col("hit"), F.col("winner"))
    asked = F.when(follows, F.col("_lead.domain_list")).otherwise(F.col("domain_list")) if domains is not None else F.lit("")

    def resolved() -> DataFrame:
        listed = [F.when(source == "tavily", asked).otherwise("").alias("result_list")] if domains is not None else []
        return rows.select(
            "req",
            "run_id",
            "entity_name",
            SEARCH_KEY,
            F.when(F.col("from_cache"), "cache")
            .when(F.col("winner") == "keyword", F.coalesce("keyword_engine", "winner"))
            .otherwise(F.coalesce("winner", F.lit("none")))
            .alias("provider"),
            F.when(F.col("hit"), F.col("cached_ok")).otherwise(source.isNotNull()).alias("ok"),
            "from_cache",
            F.when(F.col("from_cache"), 0).otherwise(F.col("credits")).cast("long").alias("credits"),
            source.alias("result_rung"),
            *listed,
        )

    def writes() -> DataFrame:
        lists = F.col("_lead.domain_list") if domains is not None else F.lit("")
        lead = leaders.select(
            SEARCH_KEY,
            F.col("_lead._text").alias("query"),
            F.col("_lead.winner").alias("_rung"),
            F.when(F.col("_lead.winner") == "tavily", lists).otherwise("").alias("_list"),
        )
        return (
            lead.join(_answers(outcomes, within), [SEARCH_KEY, "_rung", "_list"], "left")
            .select(
                SEARCH_KEY,
                "query",
                F.lit(C.SEARCH_CACHE_RUNG).alias("rung"),
                F.slice(F.coalesce("results", F.array().cast(RESULT_TYPE)), 1, n).alias("result_urls"),
                F.col("_rung").isNull().alias("empty"),
                at(as_of).alias("fetched_at"),
                (at(as_of) + F.make_dt_interval(days=F.lit(C.TTL_DAYS))).alias("expires_at"),
            )
        )

    return Resolution(resolved, lambda: _events(rows, "search", as_of), writes)


def with_results(
    resolved: DataFrame,
    outcomes: DataFrame,
    cache: DataFrame,
    n: int = C.SEARCH_JOB_RESULTS,
    domains: DataFrame | None = None,
) -> DataFrame:
    """Attach the result rows: the first ``n`` of the winning rung, or the cached list. With ``domains`` paid results are
    those within the list they were asked for with."""
    within = None
    if domains is not None:
        within = results_within(outcomes, resolved.select(SEARCH_KEY, F.col("result_list").alias("domain_list")), domains)
        resolved = resolved.withColumnRenamed("result_list", "_list")
    else:
        resolved = resolved.withColumn("_list", F.lit(""))
    found = _answers(outcomes, within).withColumnRenamed("_rung", "result_rung")
    stored = cache.select(SEARCH_KEY, F.col("result_urls").alias("_stored"))
    rows = resolved.join(found, [SEARCH_KEY, "result_rung", "_list"], "left").join(stored, SEARCH_KEY, "left")
    cached = F.col("from_cache") & F.col("result_rung").isNull()
    none = F.array().cast(RESULT_TYPE)
    return rows.withColumn(
        "results", F.coalesce(F.when(cached, F.col("_stored")).otherwise(F.slice("results", 1, n)), none)
    ).drop("_stored", "_list")


def resolve_engines(
    outcomes: DataFrame,
    order: Sequence[str] = C.FREE_ENGINES,
    configured: Iterable[str] = ALL_KEYS,
    resting: Iterable[str] = (),
) -> DataFrame:
    """Free engines inside the keyword rung: the first with results wins. Engines without a key
    or with an open breaker are left out; the list of attempts ends at the winner."""
    keys, out = set(configured), set(resting)
    engines = [e for e in order if is_configured(e, keys) and e not in out]
    ladder = [Rung("search", i, e, "free", "always") for i, e in enumerate(engines, 1)]
    flags = _by_rung(search_flags(outcomes), SEARCH_KEY, engines)
    walked = _walk(flags, ladder, keys, fetch=False, flags=[])
    attempts = F.transform("attempts", lambda a: F.struct(a["rung"].alias("provider"), a["success"].alias("ok")))
    return walked.select(
        SEARCH_KEY, F.coalesce("winner", F.lit("none")).alias("provider"), attempts.alias("attempts")
    )


def filter_domains(
    results: DataFrame, host: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Keep results of the named hosts or their subdomains; drop those of the excluded ones."""

    def within(domains: Sequence[str]) -> Column:
        test = F.lit(False)
        for d in domains:
            test = test | (host == d.lower()) | host.endswith("." + d.lower())
        return F.coalesce(test, F.lit(False))

    kept = results.where(within(include)) if include else results
    return kept.where(~within(exclude)) if exclude else kept


def keyword_answers(
    engine_outcomes: DataFrame,
    order: Sequence[str] = C.FREE_ENGINES,
    configured: Iterable[str] = ALL_KEYS,
    resting: Iterable[str] = (),
) -> DataFrame:
    """What the keyword rung gives, as rows of ``outcomes``: the results of the first free engine that has any, its name,
    and the time of all engines that were asked before and with it."""
    won = resolve_engines(engine_outcomes, order, configured, resting)
    tried = won.select(SEARCH_KEY, "provider", F.explode(F.transform("attempts", lambda a: a["provider"])).alias("rung"))
    asked = tried.join(engine_outcomes, [SEARCH_KEY, "rung"], "left")
    given = F.max(F.when(F.col("rung") == F.col("provider"), F.col("results")))
    return asked.groupBy(SEARCH_KEY).agg(
        F.coalesce(given, F.array().cast(RESULT_TYPE)).alias("results"),
        F.sum("latency_ms").alias("latency_ms"),
        F.nullif(F.max("provider"), F.lit("none")).alias("engine"),
    ).select(SEARCH_KEY, F.lit("keyword").alias("rung"), "results", "latency_ms", "engine")


def with_keyword_engines(outcomes: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcomes whose keyword rung is filled by ``keyword_answers``."""
    return outcomes.where(F.col("rung") != "keyword").unionByName(answers, allowMissingColumns=True)


# --- fetch -----------------------------------------------------------------------


def resolve_fetch(
    requests: DataFrame,
    outcomes: DataFrame,
    cache: DataFrame,
    as_of: str,
    policy: Iterable[Rung] = DEFAULT_POLICY,
    configured: Iterable[str] = ALL_KEYS,
    files: DataFrame | None = None,
) -> Resolution:
    """``requests(req, run_id, entity_name, url[, allow_parallel, cooling])`` against
    ``outcomes(url_key, rung, ok, status, content, latency_ms)`` and the page cache.

    Dead pages stop the walk and are stored as such; a leftover short body is handed out as
    ``native-thin`` but not stored. A target that is no web address is looked up in
    ``files(source, content)``.
    """
    ladder = rungs("fetch", policy)
    keyed = _keyed(requests, PAGE_KEY, with_url_key)
    entries = live(cache, as_of).select(
        PAGE_KEY,
        F.lit(True).alias("hit"),
        F.col("is_dead").alias("cached_dead"),
        F.col("http_status").alias("cached_status"),
        (cached_body(F.col("digest"), F.col("raw_excerpt")) != "").alias("cached_ok"),
    )
    flags = _by_rung(fetch_flags(outcomes), PAGE_KEY, [r.rung for r in ladder])
    rows, leaders = _settle(keyed, PAGE_KEY, entries, flags, ladder, configured, fetch=True)

    if files is None:
        rows = rows.withColumn("_found", F.lit(False))
    else:
        known = files.select(F.col("source").alias("url"), F.lit(True).alias("_is_file"))
        rows = rows.join(known, "url", "left").withColumn("_found", F.col("_local") & _truth("_is_file"))
    follows = F.coalesce(~F.col("hit") & (F.col("req") > F.col("_lead._first")), F.lit(False))
    follows = follows & ~F.col("_local")
    rows = rows.withColumns({"_follows": follows, "from_cache": F.col("hit") | follows})
    thin = F.col("winner").isNull() & ~F.col("dead") & _truth("native_has_text")
    tier = (
        F.when(F.col("_local"), F.when(F.col("_found"), "file").otherwise("missing"))
        .when(F.col("hit"), F.when(F.col("cached_dead"), "dead").otherwise("cache"))
        .when(F.col("_follows"), F.when(F.col("_lead.dead"), "dead").otherwise("cache"))
        .when(F.col("dead"), "dead")
        .when(F.col("winner").isNotNull(), F.col("winner"))
        .when(thin, "native-thin")
        .otherwise("failed")
    )
    own_status = F.when(
        F.col("dead") | (F.col("winner") == "native"), F.col("native_status")
    ).when(F.col("winner").isNotNull(), 200)
    lead_status = F.when(
        F.col("_lead.dead") | (F.col("_lead.winner") == "native"), F.col("_lead.native_status")
    ).otherwise(200)
    status = F.when(F.col("hit"), F.col("cached_status")).when(F.col("_follows"), lead_status)
    rows = rows.withColumns({"tier": tier, "_status": status.otherwise(own_status)})
    source = (
        F.when(F.col("hit"), F.lit(None))
        .when(F.col("_follows"), F.col("_lead.winner"))
        .when(F.col("tier") == "native-thin", "native")
        .otherwise(F.col("winner"))
    )
    error = (
        F.when((F.col("tier") == "dead") & F.col("from_cache"), F.format_string(C.DEAD_CACHED, "_status"))
        .when(F.col("tier") == "dead", F.format_string(C.DEAD_FRESH, "_status"))
        .when(F.col("tier") == "native-thin", C.THIN_ERROR)
        .when(F.col("tier") == "failed", C.FAILED_ERROR)
        .when(F.col("tier") == "missing", C.MISSING_ERROR)
    )
    fresh_ok = ~F.col("tier").isin("dead", "failed", "missing")

    def resolved() -> DataFrame:
        return rows.select(
            "req",
            "run_id",
            "entity_name",
            PAGE_KEY,
            "url",
            "tier",
            F.when(F.col("hit"), ~F.col("cached_dead") & F.col("cached_ok")).otherwise(fresh_ok).alias("ok"),
            "from_cache",
            F.col("_status").cast("int").alias("status"),
            F.when(F.col("from_cache"), 0).otherwise(F.col("credits")).cast("long").alias("credits"),
            error.alias("error"),
            source.alias("content_rung"),
        )

    def writes() -> DataFrame:
        text = outcomes.select(PAGE_KEY, F.col("rung").alias("_rung"), excerpt(F.col("content")).alias("_text"))
        lead = leaders.select(
            PAGE_KEY,
            F.col("_lead._text").alias("url"),
            F.col("_lead.dead").alias("is_dead"),
            F.col("_lead.native_status").alias("_status"),
            F.when(F.col("_lead.dead"), "native").otherwise(F.col("_lead.winner")).alias("_rung"),
        )
        plain = F.col("_rung") == "native"
        written = (
            lead.join(text, [PAGE_KEY, "_rung"], "left")
            .select(
                PAGE_KEY,
                "url",
                F.when(plain, F.coalesce("_status", F.lit(200))).otherwise(200).alias("http_status"),
                "is_dead",
                F.col("_rung").alias("provider"),
                F.lit(None).cast("string").alias("digest"),
                F.when(~F.col("is_dead"), F.col("_text")).alias("raw_excerpt"),
            )
        )
        return page_writes(written, as_of)

    def uses() -> DataFrame:
        return rows.where("from_cache").groupBy(PAGE_KEY).agg(F.count(F.lit(1)).alias("uses"))

    return Resolution(resolved, lambda: _events(rows, "fetch", as_of), writes, uses)


def with_content(
    resolved: DataFrame, outcomes: DataFrame, cache: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """Attach text to resolved fetches: full where fresh, the stored part where cached."""
    text = outcomes.select(PAGE_KEY, F.col("rung").alias("content_rung"), F.col("content").alias("_text"))
    stored = cache.select(PAGE_KEY, cached_body(F.col("digest"), F.col("raw_excerpt")).alias("_stored"))
    rows = resolved.join(text, [PAGE_KEY, "content_rung"], "left").join(stored, PAGE_KEY, "left")
    hit = F.col("from_cache") & F.col("content_rung").isNull()
    of_file = F.lit("")
    if files is not None:
        local = files.select(F.col("source").alias("url"), F.col("content").alias("_local_text"))
        rows, of_file = rows.join(local, "url", "left"), F.col("_local_text")
    content = (
        F.when(F.col("tier") == "dead", "")
        .when(F.col("tier") == "file", of_file)
        .when(hit, F.col("_stored"))
        .when(F.col("from_cache"), excerpt(F.col("_text")))
        .otherwise(F.col("_text"))
    )
    return rows.withColumn("content", F.coalesce(content, F.lit(""))).drop("_text", "_stored", "_local_text")


def _two_sources(requests: DataFrame, outcomes: DataFrame, call: Sequence[str]) -> DataFrame:
    """Requests with the flags of the plain and the paid outcome side by side, and the call they belong to."""
    flags = _by_rung(fetch_flags(outcomes), PAGE_KEY, ["native", "tavily"])
    keyed = _keyed(requests, PAGE_KEY, with_url_key)
    # JSON of a struct is never NULL, whatever its fields are
    return keyed.join(flags, PAGE_KEY, "left").withColumn("_call", F.to_json(F.struct(*call)) if call else F.lit(None))


def _paid_answers(
    rows: DataFrame, asked: DataFrame, call: Sequence[str], order: str, size: int, slice_rows: int
) -> DataFrame:
    """Add to ``rows`` whether the paid extract gave their page (``_paid``) and ran into a limit (``_exhausted``).

    A call asks for the pages of its rows in ``asked`` in batches of ``size``, in order. The first batch answered with
    anything but 200 ends the call: neither it nor what comes later gives pages, and a limit status marks the whole call
    as exhausted. Without call columns every request is a call of its own. Calls of any size are numbered in slices.
    """
    success, status = _truth("tavily_success"), F.col("tavily_status")
    limited = F.coalesce(status.isin(*C.COOLDOWN_STATUSES), F.lit(False))
    if not call:
        return rows.withColumns({"_paid": success, "_exhausted": limited})
    placed = numbered(asked, ["_call"], [order], slice_rows, "_place").withColumn(
        "_batch", F.floor((F.col("_place") - 1) / size)
    )
    ends = placed.groupBy("_call").agg(
        F.min(F.when(status != 200, F.col("_batch"))).alias("_end"), F.min(F.when(limited, F.col("_batch"))).alias("_limit")
    )
    pages = placed.groupBy("_call", "url").agg(F.max(success).alias("_given"), F.min("_batch").alias("_batch"))
    answers = pages.join(ends, "_call").select(
        F.col("_call").alias("_c"),
        F.col("url").alias("_u"),
        (F.col("_given") & F.coalesce(F.col("_batch") < F.col("_end"), F.lit(True))).alias("_paid"),
        F.coalesce(F.col("_end") == F.col("_limit"), F.lit(False)).alias("_exhausted"),
    )
    return rows.join(answers, (F.col("_call") == F.col("_c")) & F.col("url").eqNullSafe(F.col("_u")), "left")


def _fetch_cheap(
    requests: DataFrame, outcomes: DataFrame, depth: str, available: bool, call: Sequence[str], order: str, slice_rows: int
) -> DataFrame:
    rows = _two_sources(requests, outcomes, call)
    native, thin = _truth("native_success"), _truth("native_has_text")
    dead = ~native & is_dead(F.col("native_status"))
    if not available:
        rows = rows.withColumns({"_paid": F.lit(False), "_exhausted": F.lit(False)})
    else:
        # a page is asked for once a call, where it first comes, and only if the plain fetch left it
        flags = [F.max(c).alias(c) for c in ("tavily_success", "tavily_status")]
        asked = rows.where(~native & ~dead).groupBy("_call", "url").agg(F.min(order).alias(order), *flags) if call else rows
        rows = _paid_answers(rows, asked, call, order, C.BATCH_SIZE, slice_rows)
    exhausted = _truth("_exhausted")
    tier = (
        F.when(native, "native")
        .when(dead, "dead")
        .when(_truth("_paid"), "tavily")
        .when(thin, "native-thin")
        .otherwise("failed")
    )
    reached = F.col("tier").isin("tavily", "failed")
    return rows.withColumn("tier", tier).select(
        *[c for c in requests.columns if c != PAGE_KEY],
        PAGE_KEY,
        "tier",
        F.when(F.col("tier") == "native-thin", _truth("native_answered"))
        .otherwise(F.col("tier").isin("native", "tavily"))
        .alias("ok"),
        F.when((F.col("tier") == "tavily") | ((F.col("tier") == "failed") & F.lit(available)), "tavily")
        .otherwise("native")
        .alias("source"),
        F.when(F.col("tier") == "tavily", C.EXTRACT_CREDITS[depth]).otherwise(0).cast("long").alias("credits"),
        (reached & exhausted).alias("credits_exhausted"),
        F.when(F.col("tier") != "tavily", F.col("native_status")).alias("status"),
        _cheap_error(available, exhausted).alias("error"),
    )


def _cheap_error(available: bool, exhausted: Column) -> Column:
    tier = F.col("tier")
    dead = F.when(tier == "dead", F.format_string(C.DEAD_FRESH, "native_status"))
    if not available:
        answered = F.col("native_status").isNotNull() & (tier == "failed")
        return dead.when(answered, F.format_string(C.HTTP_ERROR, "native_status"))
    failed = F.when(exhausted, C.FAILED_EXHAUSTED_ERROR).otherwise(C.FAILED_ERROR)
    return dead.when(tier == "native-thin", C.THIN_PAID_ERROR).when(tier == "failed", failed)


def _fetch_paid_first(
    requests: DataFrame, outcomes: DataFrame, paid_first: bool, fallback: bool, call: Sequence[str], order: str, slice_rows: int
) -> DataFrame:
    rows = _two_sources(requests, outcomes, call)
    if paid_first:
        rows = _paid_answers(rows, rows, call, order, C.BATCH_SIZE, slice_rows)
    paid = F.col("_paid") if paid_first else F.lit(False)
    exhausted = F.col("_exhausted") if paid_first else F.lit(False)
    source = F.when(paid, "tavily")
    source = source.otherwise("native") if fallback else source.otherwise("tavily" if paid_first else "skipped")
    ok = (paid | _truth("native_answered")) if fallback else paid
    return rows.select(
        *[c for c in requests.columns if c != PAGE_KEY],
        PAGE_KEY,
        source.alias("source"),
        ok.alias("ok"),
        exhausted.alias("credits_exhausted"),
        F.when(~paid & F.lit(fallback), F.col("native_status")).alias("status"),
        F.when(~paid & ~F.lit(fallback), C.NOT_EXTRACTED_ERROR).alias("error"),
    )


def fetch_pages(
    requests: DataFrame,
    outcomes: DataFrame,
    mode: str = "tavily",
    depth: str = "basic",
    fallback: bool = True,
    available: bool = True,
    call: Sequence[str] = (),
    order: str = "req",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The library fetch, without cache or policy.

    ``cheap``: plain first, paid extract only for what is left. ``tavily``: paid first, plain
    fills the gaps unless ``fallback`` is off. ``fallback``: plain only. The columns in ``call``
    say which requests are fetched in one call, in the order of ``order``: they share paid batches,
    and once one is refused the rest of the call goes without. The status of a paid outcome is that
    of the batch the page was asked for in.
    """
    if mode == "cheap":
        return _fetch_cheap(requests, outcomes, depth, available, call, order, slice_rows)
    if mode in ("tavily", "fallback"):
        return _fetch_paid_first(requests, outcomes, mode == "tavily" and available, fallback, call, order, slice_rows)
    raise ValueError(f"unknown mode {mode!r}")


# --- long pages --------------------------------------------------------------------


def apply_digest(
    fetched: DataFrame, digests: DataFrame, threshold: int = C.DIGEST_THRESHOLD, no_digest: bool = False
) -> DataFrame:
    """Long fresh pages become their digest where there is one, else their beginning.

    ``digests(url_key, digest)`` come from quotes or from a model hook. A digest takes the page's
    place in the cache, so requests served from what this job fetched (``content_rung`` names the
    rung) get it too. With ``no_digest`` pages stay as they are.
    """
    if no_digest:
        return fetched.withColumns({"digested": F.lit(False), "chars_in": F.length("content").cast("long")})
    long_ = needs_digest(F.col("content"), F.col("from_cache"), threshold)
    joined = fetched.join(digests.select(PAGE_KEY, "digest"), PAGE_KEY, "left")
    some = F.coalesce(F.col("digest") != "", F.lit(False))
    done = long_ & some
    # Only a page of this job that was long enough for a digest has one in the cache.
    served = joined.where(done).select(PAGE_KEY).distinct().withColumn("_in_cache", F.lit(True))
    joined = joined.join(served, PAGE_KEY, "left")
    follows = F.col("from_cache") & F.col("content_rung").isNotNull() & F.coalesce("_in_cache", F.lit(False))
    content = F.when(done | follows, F.col("digest")).when(long_, truncated(F.col("content"), threshold))
    return (
        joined.withColumns({"digested": done, "chars_in": F.length("content").cast("long")})
        .withColumn("content", content.otherwise(F.col("content")))
        .drop("digest", "_in_cache")
    )


def digest_writes(digested: DataFrame, as_of: str) -> DataFrame:
    """Cache rows of digested pages; the digest replaces the excerpt."""
    first = F.min_by(F.struct("url", "status", "tier", "content"), "req")
    rows = digested.where("digested").groupBy(PAGE_KEY).agg(first.alias("_d")).select(
        PAGE_KEY,
        F.col("_d.url").alias("url"),
        F.col("_d.status").alias("http_status"),
        F.col("_d.tier").alias("provider"),
        F.col("_d.content").alias("digest"),
    )
    return page_writes(
        rows.withColumns(
            {
                "is_dead": F.lit(False),
                "http_status": F.coalesce("http_status", F.lit(200)),
                "raw_excerpt": F.lit(None).cast("string"),
            }
        ),
        as_of,
    )


def digest_events(digested: DataFrame, as_of: str, usd: float = C.DIGEST_USD) -> DataFrame:
    return digested.where("digested").select(
        "req",
        "run_id",
        "entity_name",
        F.lit("fetch").alias("waterfall"),
        F.lit("digest").alias("rung"),
        F.lit("cheap_model").alias("tier"),
        F.lit(True).alias("success"),
        F.lit(False).alias("from_cache"),
        F.lit(None).cast("long").alias("latency_ms"),
        F.lit(0).cast("long").alias("cost_credits"),
        F.lit(usd).cast("decimal(18,6)").alias("cost_usd"),
        at(as_of).alias("ts"),
    )


# --- hooks --------------------------------------------------------------------------

Resolver = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def run_resolver(pending: DataFrame, resolver: Resolver, schema: str) -> DataFrame:
    """A provider plug-in: Arrow batches of pending rows in, outcome rows of a fixed schema out."""
    return pending.mapInPandas(resolver, schema)


def model_digests(pages: DataFrame, model: Resolver, threshold: int = C.DIGEST_THRESHOLD) -> DataFrame:
    """Digests from a model plug-in: ``(url_key, content)`` of long pages in, ``(url_key, digest)``
    out. Checkpointed, since a model call costs money."""
    long_ = pages.where(F.length("content") > threshold).select(PAGE_KEY, "content")
    return cut_lineage(run_resolver(long_, model, "url_key string, digest string"))


def collect_outcomes(
    requests: DataFrame,
    resolvers: Mapping[str, Resolver],
    key: str,
    schema: str,
    success: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Ask providers rung by rung, each for what is still pending only.

    A provider call costs money, so each rung's answers are checkpointed: a lost executor or a
    second use never asks again. ``success`` keeps the outcome rows that settle a request.
    """
    pending, answers = requests, None
    for rung, resolver in resolvers.items():
        got = cut_lineage(run_resolver(pending, resolver, schema).withColumn("rung", F.lit(rung)))
        answers = got if answers is None else answers.unionByName(got)
        pending = pending.join(success(got).select(key), key, "left_anti")
    return answers
