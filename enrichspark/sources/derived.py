"""Working tables derived from the given ones.

The given tables hold events, pages, documents and conversations; the jobs want caches, outcomes,
requests and telemetry. Each table here is a plain projection or aggregation of a whole given
table. Outcomes (which rung failed, which page is dead) follow from row ids, so that any engine
derives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import canon_query, content_key, query_key, with_url_key
from enrichspark.functions.text import excerpt, html_text
from enrichspark.operators.cache import with_expiry
from enrichspark.operators.ordered import top_one
from enrichspark.operators.telemetry import at, fold_telemetry
from enrichspark.session import tune
from enrichspark.sources.sinks import bucketed
from enrichspark.sources.tables import known_companies

AS_OF = "2024-02-01 00:00:00"
FIELDS = ("hq_city", "employee_count", "ceo")
ANCHOR = r'<a href="([^"]+)">([^<]*)</a>'


def _mod(c: str | Column, n: int | Column) -> Column:
    return F.pmod(F.col(c) if isinstance(c, str) else c, n if isinstance(n, Column) else F.lit(n))


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Derived:
    """Derived tables over one folder of given tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- event log -------------------------------------------------------------

    @cached_property
    def rung_event(self) -> DataFrame:
        return rung_events(self.given("events"))

    @cached_property
    def telemetry_delta(self) -> DataFrame:
        return telemetry_deltas(self.rung_event)

    @cached_property
    def entity_telemetry(self) -> DataFrame:
        return fold_telemetry(self.telemetry_delta.drop("rung_hits"))

    @cached_property
    def run(self) -> DataFrame:
        """Runs seen in the log plus run 99, which has no telemetry."""
        ids = self.rung_event.select("run_id").distinct()
        extra = self.spark.range(99, 100).select(F.col("id").alias("run_id"))
        return ids.unionByName(extra).select(
            "run_id",
            F.when(_mod("run_id", 2) == 0, "sonnet").otherwise("haiku").alias("model"),
            F.when(F.col("run_id") == 5, "done").otherwise("running").alias("status"),
            F.lit(None).cast("string").alias("paused_reason"),
            F.lit(None).cast("double").alias("verified_rate"),
            F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        )

    @cached_property
    def provider_attempt(self) -> DataFrame:
        v = F.col("value")
        status = F.when(v < 5, 429).when(v < 8, 432).when(v < 15, 500).otherwise(200)
        return self.given("events").select(
            "event_id", "ts", F.col("event_type").alias("provider"), status.alias("status"), (v >= 15).alias("ok")
        )

    # --- pages ------------------------------------------------------------------

    @cached_property
    def page_text(self) -> DataFrame:
        """Every page with its key, status and text."""
        status = F.when(_mod("page_id", 17) == 0, 404).when(_mod("page_id", 17) == 1, 403).otherwise(200)
        return with_url_key(self.given("pages")).select(
            "page_id",
            "url",
            F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1)).alias("host"),
            "url_key",
            status.alias("http_status"),
            html_text(F.col("html"), "named").alias("content"),
        )

    @cached_property
    def page(self) -> DataFrame:
        """One page per key: the highest id."""
        return top_one(self.page_text, ["url_key"], [F.desc("page_id")])

    @cached_property
    def stored_page(self) -> DataFrame:
        """Every page with its key and text, bucketed by the key as a page store keeps it."""
        return bucketed(self.page, "url_key", "pages")

    def over_stored_pages(self) -> Derived:
        """The same tables, with caches, outcomes and claims made from the page store: text is extracted once."""
        twin = Derived(self.spark, self.sf_dir)
        twin.page = twin.stored_page = self.stored_page
        return twin

    @cached_property
    def page_core(self) -> DataFrame:
        return with_expiry(
            self.given("pages")
            .select(
                "page_id",
                "url",
                F.when(_mod("page_id", 17) == 0, 404)
                .when(_mod("page_id", 17) == 1, 403)
                .otherwise(200)
                .alias("http_status"),
                (at(AS_OF) - _days(_mod("page_id", 120))).alias("fetched_at"),
            )
            .withColumn("is_dead", F.col("http_status") == 404)
        )

    @cached_property
    def page_cache(self) -> DataFrame:
        dead = F.col("http_status") == 404
        digested = ~dead & (_mod("page_id", 4) == 1)
        title = F.concat(F.lit("digest of "), F.col("url"))
        body = F.when(_mod("page_id", 13) == 5, "").otherwise(excerpt(F.col("content")))
        rows = self.page.select(
            "url_key",
            "url",
            "http_status",
            dead.alias("is_dead"),
            F.when(dead, "native").otherwise(_pick(("native", "jina", "tavily"), _mod("page_id", 3))).alias("provider"),
            F.when(digested, title).alias("digest"),
            F.when(~dead & ~digested, body).alias("raw_excerpt"),
            (at(AS_OF) - _days(_mod("page_id", 120))).alias("fetched_at"),
            (_mod("page_id", 5) + 1).alias("fetch_count"),
        )
        rows = rows.withColumn("content_hash", content_key(F.col("digest"), F.col("raw_excerpt")))
        return with_expiry(rows)

    @cached_property
    def page_request(self) -> DataFrame:
        """Seven spellings per page: as is, upper case, default port, trailing slash, tracked,
        fragment, and an address no cache knows."""
        head = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
        path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
        tail = F.regexp_extract("url", r"([?#].*)$", 1)
        port = F.when(F.col("url").startswith("https"), ":443").otherwise(":80")
        mark = F.when(
            tail.startswith("?"), F.concat(F.lit("?utm_x=1&"), F.substr(tail, F.lit(2)))
        ).otherwise(F.concat(F.lit("?utm_x=1"), tail))
        spellings = F.array(
            F.col("url"),
            F.concat(F.upper(head), path, tail),
            F.concat(head, port, path, tail),
            F.concat(head, path, F.lit("/"), tail),
            F.concat(head, path, mark),
            F.concat("url", F.lit("#part")),
            F.concat(head, F.lit("/missing/"), F.col("page_id").cast("string")),
        )
        host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
        rows = self.given("pages").select("page_id", host.alias("entity_name"), F.posexplode(spellings).alias("v", "url"))
        return rows.select(
            (F.col("page_id") * 10 + F.col("v")).alias("req"),
            _mod("page_id", 6).alias("run_id"),
            "entity_name",
            "url",
            (_mod(F.col("page_id") + F.col("v"), 2) == 0).alias("allow_parallel"),
            (_mod(F.col("page_id") + F.col("v"), 5) == 0).alias("cooling"),
        )

    @cached_property
    def page_outcome(self) -> DataFrame:
        """What each rung would have answered for each page."""
        text, pid = F.col("content"), F.col("page_id")

        def answer(n: int, rung: str, ok: Column, status: Column, content: Column) -> Column:
            return F.struct(
                F.lit(rung).alias("rung"),
                ok.alias("ok"),
                status.cast("int").alias("status"),
                F.when(ok, content).otherwise("").alias("content"),
                (_mod(pid, 100) + n).alias("latency_ms"),
            )

        fine = F.lit(200)
        plain = (
            F.when(_mod(pid, 5) == 0, "")
            .when(_mod(pid, 7) == 0, "Please enable JavaScript to continue.")
            .otherwise(text)
        )
        jina, tavily = _mod(pid, 3) != 0, _mod(pid, 4) != 0
        limited = F.when(_mod(pid, 8) == 0, 429).otherwise(500)
        answers = F.array(
            answer(1, "native", F.col("http_status") == 200, F.col("http_status"), plain),
            answer(2, "jina", jina, F.when(jina, fine).otherwise(500), text),
            answer(3, "tavily", tavily, F.when(tavily, fine).otherwise(limited), text),
            answer(4, "parallel", F.lit(True), fine, text),
        )
        return self.page.select("url_key", F.inline(answers))

    # --- searches ---------------------------------------------------------------

    @cached_property
    def search_request(self) -> DataFrame:
        """Three spellings of every user turn."""
        text = F.col("text")
        spellings = F.array(
            text, F.lower(text), F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"))
        )
        users = self.given("conversations").where(F.col("role") == "user")
        rows = users.select("conv_id", "turn", F.posexplode(spellings).alias("v", "query"))
        return rows.select(
            ((F.col("conv_id") * 1000 + F.col("turn")) * 3 + F.col("v")).alias("req"),
            _mod("conv_id", 6).alias("run_id"),
            F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("entity_name"),
            "query",
            F.when(_mod("conv_id", 2) == 0, "semantic").otherwise("keyword").alias("query_intent"),
            (_mod("conv_id", 3) == 0).alias("allow_parallel"),
        )

    @cached_property
    def search_key(self) -> DataFrame:
        """Distinct queries with the lowest conversation that asked each."""
        users = self.given("conversations").where(F.col("role") == "user")
        return users.groupBy(query_key(F.col("text")).alias("query_key")).agg(
            F.min("conv_id").alias("cid"), F.min(canon_query(F.col("text"))).alias("query")
        )

    @cached_property
    def search_outcome(self) -> DataFrame:
        cid = F.col("cid")

        def answer(n: int, rung: str, empty: Column) -> Column:
            results = F.transform(
                F.sequence(F.lit(1), F.lit(8)),
                lambda i: F.struct(
                    F.concat(F.lit(f"{rung} result "), i.cast("string")).alias("title"),
                    F.concat(
                        F.lit("https://r"), i.cast("string"), F.lit(".example.com/"), cid.cast("string")
                    ).alias("url"),
                    F.col("query").alias("content"),
                ),
            )
            return F.struct(
                F.lit(rung).alias("rung"),
                F.when(empty, F.slice(results, 1, 0)).otherwise(results).alias("results"),
                (_mod(cid, 50) + n).alias("latency_ms"),
                (_pick(C.FREE_ENGINES, _mod(cid, 4)) if rung == "keyword" else F.lit(None).cast("string")).alias("engine"),
            )

        answers = F.array(
            answer(1, "keyword", _mod(cid, 5) < 3),
            answer(2, "exa", _mod(cid, 3) == 0),
            answer(3, "tavily", _mod(cid, 4) < 2),
            answer(4, "parallel", _mod(cid, 9) == 0),
        )
        return self.search_key.select("query_key", F.inline(answers))

    @cached_property
    def engine_outcome(self) -> DataFrame:
        """Free engines inside the keyword rung; engine ``n`` is empty for two of every n+2 ids."""
        results = F.array(
            F.struct(F.col("query").alias("title"), F.lit("").alias("url"), F.lit("").alias("content"))
        )
        answers = F.array(
            *[
                F.struct(
                    F.lit(e).alias("rung"),
                    F.when(_mod("cid", n + 2) < 2, F.slice(results, 1, 0)).otherwise(results).alias("results"),
                    F.lit(n).cast("long").alias("latency_ms"),
                )
                for n, e in enumerate(C.FREE_ENGINES, 1)
            ]
        )
        return self.search_key.select("query_key", F.inline(answers))

    @cached_property
    def search_cache(self) -> DataFrame:
        """Stored lists: every query of conversations whose id ends a group of three."""
        known = self.search_outcome.where((F.col("rung") == "keyword")).select("query_key", "results")
        base = self.search_key.where(_mod("cid", 3) == 2).join(known, "query_key")
        fetched = at(AS_OF) - _days(_mod("cid", 60))
        return base.select(
            "query_key",
            "query",
            F.lit(C.SEARCH_CACHE_RUNG).alias("rung"),
            F.col("results").alias("result_urls"),
            (F.size("results") == 0).alias("empty"),
            fetched.alias("fetched_at"),
            (fetched + F.make_dt_interval(days=F.lit(C.TTL_DAYS))).alias("expires_at"),
        )

    # --- accounts -----------------------------------------------------------------

    @cached_property
    def entity(self) -> DataFrame:
        """One entity per page; every tenth has no domain."""
        host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
        return self.given("pages").select(
            F.col("page_id").alias("pos"),
            F.regexp_extract(host, r"([^.]+)\.example\.", 1).alias("name"),
            F.when(_mod("page_id", 10) != 9, F.col("url")).alias("domain"),
        )

    @cached_property
    def known(self) -> DataFrame:
        """Accounts from hosts: some hosts are left out, some of those are known by name only."""
        host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
        hosts = self.given("pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("id"))
        n = F.length("host")
        name = F.upper(F.regexp_extract("host", r"([^.]+)\.example\.", 1))
        left_out = _mod(n, 4) == 0
        rows = hosts.where(~left_out | (_mod("id", 2) == 0)).select(
            "id",
            name.alias("company_name"),
            F.when(~left_out, F.concat(F.lit("https://"), F.col("host"), F.lit("/"))).alias("domain"),
            _pick(("customer", "prior-prospect", "do-not-contact"), _mod(n, 3)).alias("status"),
            F.when(_mod("id", 2) == 0, F.concat(F.lit("note "), F.col("host"))).alias("notes"),
        )
        return known_companies(rows, AS_OF)

    # --- facts --------------------------------------------------------------------------

    @cached_property
    def claim(self) -> DataFrame:
        """A quote from anywhere in every page, cited by another spelling; every fourth is altered."""
        place = _mod(F.col("page_id") * 37, F.greatest(F.length("content") - 60, F.lit(1))) + 1
        quote = F.substring("content", place.cast("int"), F.lit(60))
        return self.page.select(
            F.col("page_id").alias("claim_id"),
            _mod("page_id", 6).alias("run_id"),
            F.col("host").alias("entity_name"),
            _pick(FIELDS, _mod("page_id", 3)).alias("field"),
            F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("value"),
            F.when(_mod("page_id", 4) == 0, F.concat(quote, F.lit(" zz"))).otherwise(quote).alias("quote"),
            F.concat("url", F.lit("#cited")).alias("source_url"),
        )

    @cached_property
    def fact(self) -> DataFrame:
        """Findings of every kind, rule breaches included."""
        host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
        kind = _mod("page_id", 8)
        return self.given("pages").select(
            F.col("page_id").alias("fact_id"),
            _mod("page_id", 6).alias("run_id"),
            F.regexp_extract(host, r"([^.]+)\.example\.", 1).alias("entity_name"),
            host.alias("domain"),
            _pick(FIELDS, _mod("page_id", 3)).alias("field"),
            F.when(kind == 0, "")
            .otherwise(F.concat(F.lit("v"), _mod("page_id", 2).cast("string")))
            .alias("value"),
            F.when(kind == 2, "").otherwise(F.col("url")).alias("source_url"),
            (kind >= 2).alias("verified"),
            F.when(kind == 0, F.concat(F.lit("NOT FOUND — searched "), F.col("url")))
            .when(kind == 1, "UNVERIFIED guess")
            .otherwise("")
            .alias("note"),
        )

    @cached_property
    def want(self) -> DataFrame:
        """Two wanted fields per page, each with the texts that support it."""
        wants = F.array(
            F.struct(F.lit("article").alias("field"), F.array(F.lit("the "), F.lit("der "), F.lit("les ")).alias("terms")),
            F.struct(F.lit("host").alias("field"), F.array(F.col("host")).alias("terms")),
        )
        return self.page.select("url_key", F.inline(wants))

    # --- raw answers ---------------------------------------------------------------------

    @cached_property
    def anchor(self) -> DataFrame:
        """All links of every page, as result items."""
        html = F.col("html")
        links = F.arrays_zip(
            F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"),
            F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"),
        )
        return self.given("pages").select("page_id", links.alias("links"))


# --- stream-ready row projections -------------------------------------------------


def rung_events(events: DataFrame) -> DataFrame:
    """Attempt log from the event stream; row by row, so it serves batch and stream alike."""
    etype, value = F.col("event_type"), F.col("value")
    cached, ok = _mod("event_id", 10) == 0, F.col("value") >= 15
    return events.select(
        "event_id",
        _mod("user_id", 6).alias("run_id"),
        F.concat(F.lit("entity_"), F.col("user_id").cast("string")).alias("entity_name"),
        "event_type",
        "value",
        "props",
        F.when(~cached & etype.isin("click", "error"), "search").otherwise("fetch").alias("waterfall"),
        F.when(cached, "cache")
        .when(etype == "view", "native")
        .when(etype == "click", "keyword")
        .when(etype == "signup", "jina")
        .when(etype == "purchase", "tavily")
        .otherwise("parallel")
        .alias("rung"),
        F.when(cached | etype.isin("view", "click", "signup"), "free")
        .when(etype == "purchase", "credit")
        .otherwise("gated")
        .alias("tier"),
        (cached | ok).alias("success"),
        cached.alias("from_cache"),
        F.floor(value * 10).cast("int").alias("latency_ms"),
        F.when(~cached & ok & (etype == "purchase"), 1).otherwise(0).alias("cost_credits"),
        F.when(~cached & ok & (etype == "error"), F.lit(0.005))
        .otherwise(F.lit(0.0))
        .cast("decimal(18,6)")
        .alias("cost_usd"),
        "ts",
    )


def telemetry_deltas(rung_event: DataFrame) -> DataFrame:
    """What each attempt adds to its entity."""
    etype = F.col("event_type")
    trusted = (etype == "purchase") | ((F.col("run_id") < 3) & (etype == "signup"))
    return rung_event.select(
        "run_id",
        "entity_name",
        F.col("event_id").alias("seq"),
        F.lit(1).cast("long").alias("orchestrator_turns"),
        F.col("latency_ms").cast("long").alias("tokens_in"),
        F.length("props").cast("long").alias("tokens_out"),
        F.col("cost_credits").cast("long").alias("credits_spent"),
        F.col("cost_usd").alias("usd_spent"),
        F.col("from_cache").cast("long").alias("cache_hits"),
        trusted.cast("long").alias("verified_fields"),
        (etype == "error").cast("long").alias("unverified_fields"),
        F.when(etype.isin("view", "click"), F.concat(F.lit("d"), _mod("event_id", 3).cast("string"))).alias(
            "entity_domain"
        ),
        F.when(etype == "signup", "customer").when(etype == "purchase", "net-new").alias("internal_status"),
        F.when(F.col("value") >= 50, F.col("latency_ms")).cast("long").alias("duration_ms"),
        F.create_map("rung", F.col("latency_ms").cast("long")).alias("rung_hits"),
        F.col("ts").alias("created_at"),
    )
