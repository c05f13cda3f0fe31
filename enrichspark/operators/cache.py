"""Page and search caches: expiry, probing, upsert, reuse counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import cached_body, content_key, non_blank
from enrichspark.operators.ordered import top_one
from enrichspark.operators.telemetry import at

PAGE_KEY, SEARCH_KEY = "url_key", "query_key"
PAGE_COLUMNS = (
    "url_key",
    "url",
    "content_hash",
    "http_status",
    "is_dead",
    "provider",
    "digest",
    "raw_excerpt",
    "fetched_at",
    "expires_at",
    "fetch_count",
)


def live(df: DataFrame, as_of: str) -> DataFrame:
    """Entries that expire strictly later; the test is pushed into the Parquet scan."""
    return df.where(F.col("expires_at") > at(as_of))


def expiry(fetched_at: Column, is_dead: Column, days: int = C.TTL_DAYS, dead_days: int = C.DEAD_TTL_DAYS) -> Column:
    ttl = F.when(is_dead, F.make_dt_interval(days=F.lit(dead_days)))
    return fetched_at + ttl.otherwise(F.make_dt_interval(days=F.lit(days)))


def with_expiry(df: DataFrame, days: int = C.TTL_DAYS, dead_days: int = C.DEAD_TTL_DAYS) -> DataFrame:
    return df.withColumn("expires_at", expiry(F.col("fetched_at"), F.col("is_dead"), days, dead_days))


# --- probing -----------------------------------------------------------------


def probe_pages(requests: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Mark each request ``live``, ``dead`` or ``miss``. No page text enters the join: only
    whether a cached body exists."""
    entries = live(cache, as_of).select(
        PAGE_KEY,
        F.col("is_dead").alias("cached_dead"),
        F.col("http_status").alias("cached_status"),
        (cached_body(F.col("digest"), F.col("raw_excerpt")) != "").alias("cached_has_body"),
    )
    state = F.when(F.col("cached_dead").isNull(), "miss").when(F.col("cached_dead"), "dead").otherwise("live")
    return requests.join(entries, PAGE_KEY, "left").withColumn("probe", state)


def probe_search(requests: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Mark hits; an empty cached list is a hit too."""
    entries = live(cache, as_of).select(SEARCH_KEY, F.col("empty").alias("cached_empty"))
    return requests.join(entries, SEARCH_KEY, "left").withColumn("hit", F.col("cached_empty").isNotNull())


def misses(requests: DataFrame, cache: DataFrame, as_of: str, key: str = PAGE_KEY) -> DataFrame:
    return requests.join(live(cache, as_of).select(key), key, "left_anti")


# --- writing -----------------------------------------------------------------


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Newest write per key."""
    return top_one(df, [key], [F.desc(seq)])


def page_writes(df: DataFrame, as_of: str) -> DataFrame:
    """Cache rows from (url_key, url, http_status, is_dead, provider, digest, raw_excerpt)."""
    stamped = df.withColumns(
        {
            "content_hash": content_key(F.col("digest"), F.col("raw_excerpt")),
            "fetched_at": at(as_of),
            "fetch_count": F.lit(1).cast("long"),
        }
    )
    return with_expiry(stamped).select(*PAGE_COLUMNS)


def _upsert(cache: DataFrame, writes: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    """Replace by key; ``kept`` columns stay as they were first written."""
    old, new = cache.alias("o"), writes.alias("n")
    replaced = F.col(f"n.{key}").isNotNull()

    def column(name: str) -> Column:
        before, after = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name in kept:
            return F.when(F.col(f"o.{key}").isNotNull(), before).otherwise(after).alias(name)
        return F.when(replaced, after).otherwise(before).alias(name)

    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    rest = [column(c) for c in cache.columns if c != key]
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *rest)


def upsert_pages(cache: DataFrame, writes: DataFrame, seq: str | None = None, uses: DataFrame | None = None) -> DataFrame:
    """Insert or replace pages; address and reuse count of an existing row stay.

    ``uses(url_key, uses)`` are the requests a job served from the cache, its own entries included: they are added to the
    reuse counts in the same join.
    """
    new = latest(writes, PAGE_KEY, seq) if seq else writes
    if uses is None:
        return _upsert(cache, new, PAGE_KEY, ("url", "fetch_count"))
    # what the job touched is small beside the cache: both kinds meet first
    touched = new.withColumn("_new", F.lit(True)).join(uses.select(PAGE_KEY, "uses"), PAGE_KEY, "full")
    old, now = cache.alias("o"), touched.alias("n")
    stands, replaced = F.col(f"o.{PAGE_KEY}").isNotNull(), F.coalesce(F.col("n._new"), F.lit(False))

    def column(name: str) -> Column:
        before, after = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name == "fetch_count":
            return (F.coalesce(before, after) + F.coalesce("n.uses", F.lit(0))).cast("long").alias(name)
        if name == "url":
            return F.when(stands, before).otherwise(after).alias(name)
        return F.when(replaced, after).otherwise(before).alias(name)

    joined = old.join(now, F.col(f"o.{PAGE_KEY}") == F.col(f"n.{PAGE_KEY}"), "full").where(stands | replaced)
    rest = [column(c) for c in cache.columns if c != PAGE_KEY]
    return joined.select(F.coalesce(f"o.{PAGE_KEY}", f"n.{PAGE_KEY}").alias(PAGE_KEY), *rest)


def upsert_search(cache: DataFrame, writes: DataFrame, seq: str | None = None) -> DataFrame:
    new = latest(writes, SEARCH_KEY, seq) if seq else writes
    return _upsert(cache, new, SEARCH_KEY, ("query", "rung"))


def bump(cache: DataFrame, requests: DataFrame, as_of: str, key: str = PAGE_KEY) -> DataFrame:
    """Add each live hit to the reuse count. Requests are counted per key before the join."""
    hits = requests.groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    served = F.when(F.col("expires_at") > at(as_of), F.coalesce("_hits", F.lit(0))).otherwise(0)
    return (
        cache.join(hits, key, "left")
        .withColumn("fetch_count", F.col("fetch_count") + served)
        .select(*cache.columns)
    )


# --- reports --------------------------------------------------------------------


def cache_stats(cache: DataFrame, as_of: str) -> DataFrame:
    """Live, dead and expired entries per provider, with the share that is negative and the share
    of uses that were hits."""
    alive = F.col("expires_at") > at(as_of)
    entries = F.count(F.lit(1))
    uses = F.sum("fetch_count")
    return cache.groupBy("provider").agg(
        entries.alias("entries"),
        F.count_if(alive & ~F.col("is_dead")).alias("live"),
        F.count_if(alive & F.col("is_dead")).alias("live_dead"),
        F.count_if(~alive).alias("expired"),
        (F.count_if("is_dead") / entries).alias("negative_ratio"),
        F.try_divide((uses - entries).cast("double"), uses).alias("hit_ratio"),
    )


def changed(old: DataFrame, new: DataFrame, key: str = PAGE_KEY) -> DataFrame:
    """Keys in both snapshots whose content differs."""
    a = old.select(key, F.col("content_hash").alias("old_hash"))
    b = new.select(key, F.col("content_hash").alias("new_hash"))
    return a.join(b, key).where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def top_pages(cache: DataFrame, n: int) -> DataFrame:
    return cache.select(PAGE_KEY, "url", "fetch_count").orderBy(F.desc("fetch_count"), PAGE_KEY).limit(n)


def body_of(cache: DataFrame) -> DataFrame:
    """What each entry hands to a reader."""
    return cache.select(PAGE_KEY, cached_body(F.col("digest"), F.col("raw_excerpt")).alias("body"))


def has_digest() -> Column:
    return non_blank(F.col("digest")).isNotNull()
