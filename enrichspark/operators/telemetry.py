"""Event log and per-entity telemetry: rates, pools, costs, folds, run lifecycle, watchdog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.operators.ordered import SLICE_ROWS, numbered, trailing_blocks

COUNTERS = (
    "orchestrator_turns",
    "tokens_in",
    "tokens_out",
    "credits_spent",
    "usd_spent",
    "cache_hits",
    "verified_fields",
    "unverified_fields",
)
LAST_KNOWN = ("entity_domain", "internal_status", "duration_ms")


def _rate(verified: Column, unverified: Column) -> Column:
    """Ratio of sums; NULL where nothing was counted."""
    return verified.cast("double") / F.nullif((verified + unverified).cast("double"), F.lit(0.0))


def at(as_of: str) -> Column:
    """The job's clock as a Column; timestamps carry no zone and mean UTC."""
    return F.lit(as_of).cast("timestamp_ntz")


# --- rates, pools, costs ------------------------------------------------------


def rate_of_entities() -> tuple[Column, Column]:
    return (
        _rate(F.sum("verified_fields"), F.sum("unverified_fields")).alias("verified_rate"),
        F.count(F.lit(1)).alias("entities"),
    )


def verified_rate(tel: DataFrame) -> DataFrame:
    return tel.groupBy("run_id").agg(*rate_of_entities())


def free_pool_month(events: DataFrame) -> DataFrame:
    """Calls per free rung and calendar month, cache hits and failures included."""
    month = F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")
    return events.where(F.col("tier") == "free").groupBy("rung", month).agg(F.count(F.lit(1)).alias("calls"))


def cost_split(runs: DataFrame, tel: DataFrame) -> DataFrame:
    """Spend per run and model. Telemetry is summed per run before it meets the run table."""
    per_run = tel.groupBy("run_id").agg(
        F.sum("credits_spent").alias("tavily_credits"),
        F.sum("usd_spent").alias("api_usd"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("orchestrator_tokens"),
        F.sum("orchestrator_turns").alias("orchestrator_turns"),
        F.sum("cache_hits").alias("cache_hits"),
    )
    return runs.select("run_id", "model").join(per_run, "run_id")


def rung_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("waterfall", "rung").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("successes"),
        (F.count_if("success") / F.count(F.lit(1))).alias("success_rate"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def rung_percentile(events: DataFrame, share: float = 0.95) -> DataFrame:
    """Per rung the smallest latency that at least ``share`` of its timed attempts stay within.

    Exact: attempts are counted per whole millisecond first, on the map side too, so the running
    count goes over the latencies seen and not over the attempts.
    """
    rung = ["waterfall", "rung"]
    timed = events.where(F.col("latency_ms").isNotNull()).groupBy(*rung, "latency_ms").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*rung).orderBy("latency_ms"))
    total = F.sum("_n").over(Window.partitionBy(*rung))
    return (
        timed.select(*rung, "latency_ms", upto.alias("_upto"), total.alias("_total"))
        .groupBy(*rung)
        .agg(
            F.max("_total").alias("timed"),
            F.min(F.when(F.col("_upto") >= F.ceil(F.col("_total") * F.lit(share)), F.col("latency_ms"))).alias("latency_ms"),
        )
    )


def tier_costs(events: DataFrame, credit_usd: float = C.GATED_REQUEST_USD) -> DataFrame:
    """Operations, share and cost per tier with a total row; credits cost nothing while the free
    pool lasts (``cost_low``) and ``credit_usd`` each beyond it (``cost_high``)."""
    per_tier = events.rollup("tier").agg(
        F.grouping("tier").alias("is_total"),
        F.count(F.lit(1)).alias("ops"),
        F.sum("cost_usd").cast("double").alias("cost_low"),
        F.sum("cost_credits").alias("credits"),
    )
    # One row per tier is left, so the share needs no partitioning.
    total_ops = F.max("ops").over(Window.partitionBy())
    high = F.col("cost_low") + F.col("credits") * F.lit(credit_usd)
    return per_tier.select(
        F.when(F.col("is_total") == 1, "total").otherwise(F.col("tier")).alias("tier"),
        "ops",
        (F.col("ops") / total_ops).alias("share"),
        "credits",
        "cost_low",
        high.alias("cost_high"),
        (high / F.col("ops")).alias("unit_cost"),
    )


def saving(events: DataFrame, unit: float = C.GATED_REQUEST_USD) -> DataFrame:
    """Actual cost against every operation paid at a flat price."""
    cost = (F.sum("cost_usd").cast("double") + F.sum("cost_credits") * F.lit(unit)).alias("cost")
    return (
        events.agg(F.count(F.lit(1)).alias("ops"), cost)
        .withColumn("baseline", F.col("ops") * F.lit(unit))
        .withColumn("ratio", F.try_divide("baseline", "cost"))
    )


def budget_status(burn: DataFrame, budgets: Mapping[str, int | None] = C.MONTHLY_FREE) -> DataFrame:
    """Every budgeted pool in every month on record; a pool without calls counts as 0."""
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("rung"), F.lit(n).cast("long").alias("monthly_free"))
            for r, n in budgets.items()
        ]
    )
    pools = burn.select("month").distinct().select("month", F.inline(rows))
    calls = F.coalesce("calls", F.lit(0)).cast("long")
    return pools.join(burn, ["rung", "month"], "left").select(
        "rung",
        "month",
        "monthly_free",
        calls.alias("calls"),
        (F.col("monthly_free") - calls).alias("remaining"),
        F.coalesce(calls > F.col("monthly_free"), F.lit(False)).alias("over_budget"),
    )


def one_time_status(events: DataFrame, budgets: Mapping[str, int] = C.ONE_TIME_FREE) -> DataFrame:
    """Every pool that is granted once: calls so far and what is left of it."""
    spark = events.sparkSession
    pools = spark.createDataFrame(list(budgets.items()), "rung string, one_time_free long")
    asked = events.where(F.col("rung").isin(*budgets) & ~F.col("from_cache")).groupBy("rung")
    calls = F.coalesce("calls", F.lit(0)).cast("long")
    return pools.join(asked.agg(F.count(F.lit(1)).alias("calls")), "rung", "left").select(
        "rung",
        "one_time_free",
        calls.alias("calls"),
        F.greatest(F.col("one_time_free") - calls, F.lit(0)).alias("remaining"),
        (calls >= F.col("one_time_free")).alias("used_up"),
    )


def run_summary(entities: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: entities in and returned, verified and unverified facts, paused."""
    given = entities.groupBy("run_id").agg(F.count(F.lit(1)).alias("entities_in"))
    found = rows.groupBy("run_id").agg(
        F.countDistinct("entity_name").alias("entities_returned"),
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("unverified"),
    )
    paused = F.coalesce(F.col("status") == "paused", F.lit(False)).alias("paused")
    state = runs.select("run_id", paused)
    counts = [
        F.coalesce(c, F.lit(0)).cast("long").alias(c)
        for c in ("entities_in", "entities_returned", "verified", "unverified")
    ]
    return given.join(found, "run_id", "left").join(state, "run_id", "left").select("run_id", *counts, "paused")


# --- telemetry fold -----------------------------------------------------------


def _last_known(value: str, seq: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))


def fold_rung_hits(deltas: DataFrame, seq: str = "seq") -> DataFrame:
    """Per (run, entity, rung) the value written last; values replace, they do not add."""
    entries = deltas.select("run_id", "entity_name", seq, F.explode("rung_hits").alias("rung", "hits"))
    return entries.groupBy("run_id", "entity_name", "rung").agg(F.max_by("hits", seq).alias("hits"))


def fold_telemetry(deltas: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (run, entity): counters add, texts keep the last non-null, maps merge."""
    key = ["run_id", "entity_name"]
    folded = deltas.groupBy(*key).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS if c in deltas.columns],
        *[_last_known(c, seq).alias(c) for c in LAST_KNOWN if c in deltas.columns],
        F.min("created_at").alias("created_at"),
    )
    if "rung_hits" not in deltas.columns:
        return folded
    # A map holds at most one entry per rung of the policy.
    entry = F.struct(F.col("rung").alias("key"), F.col("hits").alias("value"))
    hits = fold_rung_hits(deltas, seq).groupBy(*key)
    hits = hits.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rung_hits"))
    empty = F.create_map().cast(dict(deltas.dtypes)["rung_hits"])
    return folded.join(hits, key, "left").withColumn("rung_hits", F.coalesce("rung_hits", empty))


def upsert_telemetry(state: DataFrame, deltas: DataFrame, seq: str = "seq") -> DataFrame:
    """Fold the deltas first, then meet the much larger state once."""
    key = ["run_id", "entity_name"]
    new = fold_telemetry(deltas, seq)

    def both(name: str) -> Column:
        old_v, new_v = F.col(f"s.{name}"), F.col(f"d.{name}")
        if name in COUNTERS:
            return (F.coalesce(old_v, F.lit(0)) + F.coalesce(new_v, F.lit(0))).alias(name)
        if name == "created_at":
            return F.coalesce(old_v, new_v).alias(name)
        if name == "rung_hits":
            kept = F.map_filter(old_v, lambda k, _: ~F.coalesce(F.map_contains_key(new_v, k), F.lit(False)))
            merged = F.when(old_v.isNull(), new_v).when(new_v.isNull(), old_v)
            return merged.otherwise(F.map_concat(kept, new_v)).alias(name)
        return F.coalesce(new_v, old_v).alias(name)

    joined = state.alias("s").join(new.alias("d"), key, "full")
    return joined.select(*key, *[both(c) for c in new.columns if c not in key])


# --- run lifecycle -----------------------------------------------------------------


def create_runs(df: DataFrame, as_of: str) -> DataFrame:
    """New run rows with their defaults; run ids are inputs."""
    have = set(df.columns)

    def given(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in have else default).alias(name)

    return df.select(
        "run_id",
        given("client_schema", F.lit(None).cast("string")),
        given("entity_type", F.lit("company")),
        given("model", F.lit("sonnet")),
        given("purpose", F.lit("")),
        given("brief", F.lit("")),
        given("entity_count", F.lit(0)),
        at(as_of).alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit("running").alias("status"),
        F.lit(None).cast("double").alias("verified_rate"),
        F.lit(None).cast("string").alias("paused_reason"),
    )


def finish_runs(runs: DataFrame, tel: DataFrame, as_of: str, status: str = "done") -> DataFrame:
    """Close runs whatever their state, copying the rate reached (NULL without telemetry)."""
    rates = verified_rate(tel).select("run_id", F.col("verified_rate").alias("_rate"))
    return (
        runs.join(rates, "run_id", "left")
        .withColumns(
            {"status": F.lit(status), "finished_at": at(as_of), "verified_rate": F.col("_rate")}
        )
        .drop("_rate")
    )


def drop_runs(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of runs that are not being deleted; serves the run table and both its children."""
    return df.join(ids.select("run_id"), "run_id", "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a uniqueness rule."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def field_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("run_id", "entity_name").agg(
        F.count_if("verified").alias("verified_fields"),
        F.count_if(~F.col("verified")).alias("unverified_fields"),
    )


# --- watchdog --------------------------------------------------------------------


def trailing_rate(tel: DataFrame, window: int = C.WATCHDOG_WINDOW) -> DataFrame:
    """Rate over the newest entities of each run; Spark keeps only ``window`` rows per run and
    task ahead of the shuffle."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("created_at"), "entity_name")
    return (
        tel.select("run_id", "entity_name", "created_at", "verified_fields", "unverified_fields")
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= (window or C.WATCHDOG_WINDOW))
        .groupBy("run_id")
        .agg(
            _rate(F.sum("verified_fields"), F.sum("unverified_fields")).alias("rate"),
            F.count(F.lit(1)).alias("entities"),
        )
    )


def watchdog(
    tel: DataFrame,
    runs: DataFrame,
    window: int = C.WATCHDOG_WINDOW,
    min_rate: float = C.WATCHDOG_MIN_RATE,
) -> DataFrame:
    """Pause verdict per run and the run's status after it; only running runs change."""
    window = window or C.WATCHDOG_WINDOW
    paused = F.coalesce((F.col("entities") >= window) & (F.col("rate") < min_rate), F.lit(False))
    reason = F.format_string(
        f"verified-rate %.2f < {min_rate} over trailing %d entities", F.col("rate"), F.col("entities")
    )
    pausing = F.col("paused") & (F.col("status") == "running")
    return (
        runs.select("run_id", "status")
        .join(trailing_rate(tel, window), "run_id", "left")
        # A run that has counted nothing reports no entities.
        .withColumn("entities", F.when(F.col("rate").isNull(), 0).otherwise(F.col("entities")).cast("long"))
        .withColumn("paused", paused)
        .withColumn("reason", F.when(F.col("paused"), reason))
        .withColumn("status", F.when(pausing, "paused").otherwise(F.col("status")))
    )


def pause_runs(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Run rows with the watchdog's verdict written in, where the run is still running."""
    v = verdicts.where("paused").select("run_id", F.col("reason").alias("_reason"))
    hit = F.col("_reason").isNotNull() & (F.col("status") == "running")
    return (
        runs.join(v, "run_id", "left")
        .withColumn("paused_reason", F.when(hit, F.col("_reason")).otherwise(F.col("paused_reason")))
        .withColumn("status", F.when(hit, "paused").otherwise(F.col("status")))
        .drop("_reason")
    )


def watchdog_trail(
    tel: DataFrame, window: int = C.WATCHDOG_WINDOW, slice_rows: int = SLICE_ROWS, block: int = 50_000
) -> DataFrame:
    """The trailing rate as it was after each entity, for runs of any length."""
    order = ["created_at", "entity_name"]
    slim = tel.select("run_id", *order, "verified_fields", "unverified_fields")
    rows = numbered(slim, ["run_id"], order, slice_rows)
    w = Window.partitionBy("run_id", "_block").orderBy("rn").rowsBetween(-(window - 1), 0)
    return (
        trailing_blocks(rows, "rn", window, block)
        .withColumn("rate", _rate(F.sum("verified_fields").over(w), F.sum("unverified_fields").over(w)))
        .where(~F.col("_copy"))
        .select("run_id", "entity_name", "created_at", F.col("rn").alias("nth"), "rate")
    )
