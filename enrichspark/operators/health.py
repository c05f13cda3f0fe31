"""Provider health from attempt logs: breaker openings, cooldown intervals, call batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.operators.ordered import SLICE_ROWS, running, sliced


def breaker(
    attempts: DataFrame,
    by: Sequence[str] = ("provider",),
    order: Sequence[str] = ("ts", "event_id"),
    failures: int = C.BREAKER_FAILURES,
    seconds: int = C.BREAKER_SECONDS,
    slice_rows: int = SLICE_ROWS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Where the breaker opened in a log of attempts that really ran.

    Opening resets the counter, so of the failures since the last success every
    ``failures``-th opens it. Runs as two sliced scans: failures so far, and that count as it
    stood at the last success. ``carried`` holds the streak each provider came in with.
    """
    by, order = list(by), list(order)
    cut = sliced(attempts, by, order, slice_rows)
    failed = F.when(F.col("ok"), 0).otherwise(1)
    counted = running(cut, by, order, "_slice", sums={"_failed": failed})
    at_success = F.when(F.col("ok"), F.col("_failed"))
    streaks = running(counted, by, order, "_slice", maxes={"_cleared": at_success})
    came_in = F.lit(0)
    if carried is not None:
        streaks = streaks.join(carried.select(*by, F.col("streak").alias("_came_in")), by, "left")
        came_in = F.coalesce("_came_in", F.lit(0))
    streak = F.col("_failed") - F.coalesce(F.col("_cleared"), -came_in)
    opens = ~F.col("ok") & (F.pmod(streak, F.lit(failures)) == 0)
    until = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    return streaks.select(
        *attempts.columns,
        streak.cast("long").alias("streak"),
        opens.alias("opens"),
        F.when(opens, until).alias("open_until"),
    )


def cooldowns(
    attempts: DataFrame,
    by: Sequence[str] = ("provider",),
    order: Sequence[str] = ("ts", "event_id"),
    seconds: int = C.COOLDOWN_SECONDS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Merged intervals in which a provider rests after limit responses; a trip inside an
    interval extends it."""
    by, order = list(by), list(order)
    trips = attempts.where(F.col("status").isin(*C.COOLDOWN_STATUSES)).select(*by, *order)
    trips = sliced(trips, by, order, slice_rows)
    trips = trips.withColumn("until", F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)))
    seen = running(trips, by, order, "_slice", maxes={"_latest": F.col("until")}, before=True)
    starts = F.when(F.coalesce(F.col("_latest") > F.col("ts"), F.lit(False)), 0).otherwise(1)
    islands = running(seen, by, order, "_slice", sums={"_island": starts})
    return (
        islands.groupBy(*by, "_island")
        .agg(
            F.min("ts").alias("cooling_from"),
            F.max("until").alias("cooling_until"),
            F.count(F.lit(1)).alias("trips"),
        )
        .drop("_island")
    )


def assign_batches(
    df: DataFrame, n: int = C.BATCH_SIZE, key: str = "url_key", bucket_rows: int = 100_000
) -> DataFrame:
    """Number the distinct pending keys into batches of at most ``n``.

    Numbering runs inside buckets given by the first hex digits of the key, one digit at least and
    as many as leave about ``bucket_rows`` rows in each. Keys are hashes and distinct, so buckets
    are even.
    """
    w = Window.partitionBy("batch_bucket").orderBy(key)
    digits = max(1, math.ceil(math.log(max(df.count(), 1) / bucket_rows, 16)))
    pending = df.select(key).distinct().withColumn("batch_bucket", F.substring(key, 1, digits))
    return pending.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
