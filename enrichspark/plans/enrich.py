"""The whole job: known accounts, suppression, fetches, verification, rows, telemetry."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import canon_domain
from enrichspark.functions.policy import DEFAULT_POLICY, Rung
from enrichspark.operators import accounts, cache, facts, resolve, telemetry


class Enrichment:
    """One pass over a list of entities; each output is planned when asked for.

    ``entities(pos, entity_name, name, domain)``, ``requests`` and ``claims`` carry
    ``run_id`` and ``entity_name``; ``pages(url_key, content)`` are the raw stored pages that
    claims are checked against.
    """

    def __init__(
        self,
        entities: DataFrame,
        known: DataFrame | None,
        requests: DataFrame,
        outcomes: DataFrame,
        page_cache: DataFrame,
        claims: DataFrame,
        pages: DataFrame,
        as_of: str,
        suppressed: Iterable[str] = C.SUPPRESSED_STATUSES,
        policy: Iterable[Rung] = DEFAULT_POLICY,
        configured: Iterable[str] = resolve.ALL_KEYS,
    ):
        checked = accounts.xref(entities, known) if known is not None else accounts.xref_without_table(entities)
        # Suppressed entities leave before anything is asked or paid for.
        self.entities = accounts.suppress(checked, list(suppressed))
        wanted = self.entities.select("entity_name")
        self.page_cache = page_cache
        self.claims = claims.join(wanted, "entity_name", "left_semi")
        self.pages = pages
        self.fetches = resolve.resolve_fetch(
            requests.join(wanted, "entity_name", "left_semi"), outcomes, page_cache, as_of, policy, configured
        )

    @cached_property
    def checked(self) -> DataFrame:
        return facts.verify_claims(self.claims, self.pages)

    @cached_property
    def rows(self) -> DataFrame:
        """Findings: verified and sourced, or blank with a note, each with the entity's status."""
        return accounts.attach_xref(facts.blank_unverified(self.checked).drop("quote", "url_key"), self.entities)

    @cached_property
    def telemetry(self) -> DataFrame:
        """Per run and entity: attempts, spend, successes by rung, time and field counts. An entity with either kind of
        row counts."""
        key = ["run_id", "entity_name"]
        # folded by rung first, so that the map of an entity is made of one row per rung of the policy
        by_rung = self.fetches.events.groupBy(*key, "rung").agg(
            F.count(F.lit(1)).alias("turns"),
            F.sum("cost_credits").alias("credits"),
            F.sum("cost_usd").alias("usd"),
            F.count_if("from_cache").alias("hits"),
            F.count_if("success").alias("won"),
            F.sum("latency_ms").alias("ms"),
        )
        won = F.when(F.col("won") > 0, F.struct(F.col("rung").alias("key"), F.col("won").alias("value")))
        spent = by_rung.groupBy(*key).agg(
            F.sum("turns").alias("orchestrator_turns"),
            F.sum("credits").alias("credits_spent"),
            F.sum("usd").alias("usd_spent"),
            F.sum("hits").alias("cache_hits"),
            F.map_from_entries(F.array_sort(F.collect_list(won))).alias("rung_hits"),
            F.sum("ms").alias("duration_ms"),
        )
        # Counted from the claims themselves: neither the account columns nor the texts travel with them.
        counts = telemetry.field_counts(self.checked)
        numbers = ["orchestrator_turns", "credits_spent", "usd_spent", "cache_hits", "verified_fields", "unverified_fields"]
        return spent.join(counts, key, "full").fillna(0, numbers)

    @cached_property
    def entity_telemetry(self) -> DataFrame:
        """``telemetry`` with each entity's domain and internal status."""
        one = F.min(F.struct(canon_domain(F.col("domain")).alias("domain"), "internal_status"))
        named = self.entities.groupBy("entity_name").agg(one.alias("_e")).select(
            "entity_name", F.col("_e.domain").alias("entity_domain"), F.col("_e.internal_status").alias("internal_status")
        )
        return self.telemetry.join(named, "entity_name", "left")

    @cached_property
    def report(self) -> DataFrame:
        """Per run: what was done, what it cost, how much of it held."""
        return self.telemetry.groupBy("run_id").agg(
            F.sum("orchestrator_turns").alias("attempts"),
            F.sum("cache_hits").alias("cache_hits"),
            F.sum("credits_spent").alias("credits"),
            F.sum("usd_spent").alias("usd"),
            *telemetry.rate_of_entities(),
        )

    @cached_property
    def page_cache_after(self) -> DataFrame:
        """Pages fetched by this job stored, and every request it served from the cache counted."""
        return cache.upsert_pages(self.page_cache, self.fetches.writes, uses=self.fetches.uses)
