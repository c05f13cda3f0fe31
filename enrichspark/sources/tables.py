"""The stored tables: schemas, scans and the projections applied on write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import canon_domain
from enrichspark.operators.telemetry import at

SCHEMAS = {
    "page_cache": (
        "url_key string, url string, content_hash string, http_status int, is_dead boolean, "
        "provider string, digest string, raw_excerpt string, fetched_at timestamp_ntz, "
        "expires_at timestamp_ntz, fetch_count bigint"
    ),
    "search_cache": (
        "query_key string, query string, rung string, "
        "result_urls array<struct<title:string,url:string,content:string>>, empty boolean, "
        "fetched_at timestamp_ntz, expires_at timestamp_ntz"
    ),
    "run": (
        "run_id string, client_schema string, entity_type string, model string, purpose string, "
        "brief string, entity_count int, started_at timestamp_ntz, finished_at timestamp_ntz, "
        "status string, verified_rate double, paused_reason string"
    ),
    "entity_telemetry": (
        "run_id string, entity_name string, entity_domain string, orchestrator_turns bigint, "
        "tokens_in bigint, tokens_out bigint, rung_hits map<string,bigint>, credits_spent bigint, "
        "usd_spent decimal(18,6), cache_hits bigint, verified_fields bigint, "
        "unverified_fields bigint, internal_status string, duration_ms bigint, created_at timestamp_ntz"
    ),
    "rung_event": (
        "run_id string, entity_name string, waterfall string, rung string, tier string, "
        "success boolean, from_cache boolean, latency_ms bigint, cost_credits bigint, "
        "cost_usd decimal(18,6), ts timestamp_ntz"
    ),
    "known_companies": (
        "id bigint, company_name string, domain string, domain_normalized string, status string, "
        "notes string, updated_at timestamp_ntz"
    ),
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan a stored table with its fixed schema; filters and columns reach the Parquet reader."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "page_cache", path)


def read_search(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "search_cache", path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "run", path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "entity_telemetry", path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "rung_event", path)


def read_known(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "known_companies", path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Scan a table kept in a database, split on ``column`` so that many tasks read at once."""
    return spark.read.jdbc(
        url,
        table,
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=options,
    )


def known_companies(df: DataFrame, as_of: str) -> DataFrame:
    """Account rows as they are stored: status default, canonical domain and change time set."""
    return df.select(
        "id",
        "company_name",
        "domain",
        canon_domain(F.col("domain")).alias("domain_normalized"),
        F.coalesce("status", F.lit(C.KNOWN_STATUS_DEFAULT)).alias("status"),
        "notes",
        at(as_of).alias("updated_at"),
    )


def event_rows(df: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Event rows with what the log fills in: not from the cache, no credits, no cost."""
    values = {"from_cache": False, "cost_credits": 0, "cost_usd": 0, **(defaults or {})}
    types = dict(part.strip().split(" ", 1) for part in SCHEMAS["rung_event"].replace("(18,6)", "(18;6)").split(","))
    out = []
    for name, dtype in types.items():
        value = F.col(name) if name in df.columns else F.lit(None)
        if name in values:
            value = F.coalesce(value, F.lit(values[name]))
        out.append(value.cast(dtype.replace(";", ",")).alias(name))
    return df.select(*out)
