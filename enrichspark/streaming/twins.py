"""Streams over the event log; each gives what its batch operator gives on the same rows.

Results that change as data arrives are written per micro-batch under the batch's number, so a
retried batch replaces its own rows, and read back with the newest batch winning. State that grows
with the data is kept in levels or by time slice, and a micro-batch rewrites only what it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from enrichspark import constants as C
from enrichspark.operators import health, telemetry
from enrichspark.operators.ordered import top_one
from enrichspark.session import cut_lineage
from enrichspark.streaming.levels import Levels, Manifests


def read_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``files`` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def _start(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(availableNow=True).start()


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    def each(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _start(df, checkpoint, each, mode)


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return top_one(spark.read.parquet(path), keys, [F.desc("batch")]).drop("batch")


# --- declarative twins ----------------------------------------------------------------


def pool_month(events: DataFrame) -> DataFrame:
    """Monthly free-pool calls. State is one count per rung and month."""
    return telemetry.free_pool_month(events)


def rung_windows(events: DataFrame, late: str | None = None, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Attempts and successes per rung in event-time windows.

    Every row counts, in whatever order files arrive; state is one row per rung and window. With
    ``late`` windows older than that leave the state, and rows that come later still are dropped.
    """
    # Watermarks want a zoned timestamp; the session runs in UTC, so nothing moves.
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = timed.groupBy(window, "waterfall", "rung")
    return counted.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("successes"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    ).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        "waterfall",
        "rung",
        "attempts",
        "successes",
        "avg_latency_ms",
    )


# --- running state ---------------------------------------------------------------------


def telemetry_levels(spark: SparkSession, path: str, fan: int = 2) -> Levels:
    """Telemetry kept as levels of folded micro-batches; later batches win where values replace."""
    return Levels(spark, path, lambda rows: telemetry.fold_telemetry(rows), fan)


def fold_stream(deltas: DataFrame, path: str, checkpoint: str, fan: int = 2) -> StreamingQuery:
    """Telemetry upserts as a stream: each micro-batch is folded and added to the levels under ``path``."""

    def each(rows: DataFrame, batch: int) -> None:
        telemetry_levels(rows.sparkSession, path, fan).apply(batch, telemetry.fold_telemetry(rows))

    return _start(deltas, checkpoint, each, "append")


def folded(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry as of the last batch."""
    return telemetry_levels(spark, path).read()


def fresh_keys(
    requests: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    key: str = "url_key",
    ts: str = "ts",
    days: int = C.TTL_DAYS,
    late_days: int = 1,
) -> StreamingQuery:
    """Requests of a stream that no stored entry answers, as ``(key, ts)`` rows under ``path``.

    An entry is stored by the request that finds none, and lives ``days``; at the moment it expires it is gone. Requests
    of a micro-batch are served by time; one that comes later than its time finds what is stored when it comes. The
    state is the expiry of each key, and forgets what has been gone for ``late_days`` of event time.

    A key's requests are never gathered: each round takes the earliest unanswered request of every key by a plain
    minimum, so a micro-batch takes as many rounds as it spans lifetimes of a key.
    """

    def levels(spark: SparkSession, horizon: Column | None = None) -> Levels:
        def newest(rows: DataFrame) -> DataFrame:
            held = rows.groupBy(key).agg(F.max("expires").alias("expires"))
            return held if horizon is None else held.where(F.col("expires") > horizon)

        return Levels(spark, state, newest)

    def each(rows: DataFrame, batch: int) -> None:
        spark, store = rows.sparkSession, levels(rows.sparkSession)
        if batch <= store.last():
            return  # its misses were written before its state
        lifetime = F.make_dt_interval(days=F.lit(days))
        asked = cut_lineage(rows.select(key, F.col(ts).cast("timestamp_ntz").alias("ts")).where("ts is not null"))
        held = store.read()
        if held is None:
            waiting = asked
        else:
            # only the expiries of keys that are asked for leave the state
            wanted, due = asked.select(F.col(key).alias("_asked")).distinct(), held.withColumnRenamed(key, "_held")
            due = due.join(wanted, F.col("_held").eqNullSafe(F.col("_asked")), "left_semi")
            waiting = asked.join(due, F.col(key).eqNullSafe(F.col("_held")), "left")
            waiting = waiting.where(F.col("expires").isNull() | (F.col("ts") >= F.col("expires"))).select(key, "ts")
        missed = None
        while True:
            first = cut_lineage(waiting.groupBy(key).agg(F.min("ts").alias("ts")))
            if first.isEmpty():
                break
            missed = first if missed is None else missed.unionByName(first)
            until = first.select(F.col(key).alias("_key"), (F.col("ts") + lifetime).alias("_until"))
            waiting = waiting.join(until, F.col(key).eqNullSafe(F.col("_key"))).where("ts >= _until").select(key, "ts")
        missed = first if missed is None else missed
        missed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        latest = asked.agg(F.max("ts").cast("string")).first()[0]
        horizon = F.lit(latest).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(late_days))
        expiries = missed.groupBy(key).agg((F.max("ts") + lifetime).alias("expires"))
        levels(spark, horizon if latest else None).apply(batch, expiries)

    return _start(requests, checkpoint, each, "append")


def _previous(spark: SparkSession, root: str, batch: int) -> DataFrame | None:
    """State left by the batch before; batch numbers have no gaps."""
    return spark.read.parquet(f"{root}/v={batch - 1}") if batch else None


def watchdog_stream(
    finished: DataFrame, state: str, checkpoint: str, window: int = C.WATCHDOG_WINDOW
) -> StreamingQuery:
    """Keep the newest ``window`` entities per run from a stream of finished entities, one row
    each. Only those rows reach the shuffle and the state."""
    cols = ["run_id", "entity_name", "created_at", "verified_fields", "unverified_fields"]
    newest = Window.partitionBy("run_id").orderBy(F.desc("created_at"), "entity_name")

    def each(rows: DataFrame, batch: int) -> None:
        before = _previous(rows.sparkSession, state, batch)
        seen = rows.select(*cols) if before is None else before.select(*cols).unionByName(rows.select(*cols))
        kept = seen.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= window).drop("_rn")
        kept.write.mode("overwrite").parquet(f"{state}/v={batch}")

    return _start(finished, checkpoint, each, "append")


def last_state(spark: SparkSession, query: StreamingQuery, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={query.lastProgress['batchId']}")


class Breakers:
    """Breaker streaks over a log whose attempts come in any order.

    Attempts are stored by time slice, each with the failures since the last success *in its slice*. What came before a
    slice enters by a summary of one row per provider and slice: how its streak ends, and whether it saw a success. So
    a late attempt changes the stored rows of its own slice alone, and the summary carries the rest on when streaks are
    read. A slice's rows are replaced as a whole under the number of the batch that touched it; a manifest says which
    batch holds which slice, so retries are harmless.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ("provider",), slice_by: str = "hour"):
        self.spark, self.path, self.by, self.unit = spark, path.rstrip("/"), list(by), slice_by
        self.manifests = Manifests(spark, f"{self.path}/manifest")

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/v={batch:012d}"

    def _stored(self, kind: str, slices: dict[str, int], sizes: dict[str, int]) -> DataFrame | None:
        """The rows of the given slices, each from the batch that last touched it."""
        batches: dict[int, list[str]] = {}
        for name, batch in slices.items():
            batches.setdefault(batch, []).append(name)
        out = None
        for batch, names in sorted(batches.items()):
            part = self.spark.read.parquet(self._folder(kind, batch))
            if len(names) < sizes[str(batch)]:  # other slices of that batch were replaced since
                part = part.where(F.col("_at").cast("string").isin(names))
            out = part if out is None else out.unionByName(part)
        return out

    def apply(self, batch: int, attempts: DataFrame) -> None:
        """Add one micro-batch; attempts that are stored already (by ``event_id``) change nothing."""
        last, held = self.manifests.newest()
        if batch <= last:
            return
        slices, sizes = dict(held.get("slices", {})), dict(held.get("sizes", {}))
        new = cut_lineage(attempts.withColumn("_at", F.date_trunc(self.unit, "ts").cast("timestamp_ntz")))
        # a micro-batch touches few slices of time, whatever it holds
        touched = new.agg(F.array_sort(F.collect_set(F.col("_at").cast("string")))).first()[0]
        if not touched:
            self.manifests.put(batch, {"slices": slices, "sizes": sizes})
            return
        before = self._stored("rows", {t: slices[t] for t in touched if t in slices}, sizes)
        if before is not None:
            new = before.select(*new.columns).unionByName(new)
        new = new.dropDuplicates(["event_id"])
        place = [*self.by, "_at"]
        local = health.breaker(new, place).select(*new.columns, F.col("streak").alias("_local"))
        firsts = new.where("ok").groupBy(*place).agg(F.min(F.struct("ts", "event_id")).alias("_first"))
        local = local.join(firsts, place, "left")
        lead = F.col("_first").isNull() | (F.struct("ts", "event_id") < F.col("_first"))
        rows = local.withColumn("_lead", lead).drop("_first")
        rows.write.mode("overwrite").parquet(self._folder("rows", batch))
        written = self.spark.read.schema(rows.schema).parquet(self._folder("rows", batch))
        written.groupBy(*place).agg(
            F.max_by("_local", F.struct("ts", "event_id")).alias("_ends"), F.bool_or(~F.col("_lead")).alias("_clears")
        ).write.mode("overwrite").parquet(self._folder("summary", batch))
        slices |= {t: batch for t in touched}
        sizes[str(batch)] = len(touched)
        used = {str(b) for b in slices.values()}
        self.manifests.put(batch, {"slices": slices, "sizes": {b: n for b, n in sizes.items() if b in used}})
        self.manifests.expire(lambda m: {self._folder(k, b) for b in m["slices"].values() for k in ("rows", "summary")})

    def read(self, failures: int = C.BREAKER_FAILURES, seconds: int = C.BREAKER_SECONDS) -> DataFrame | None:
        """What ``health.breaker`` gives on all attempts so far; None before the first."""
        held = self.manifests.newest()[1]
        if not held.get("slices"):
            return None
        # one row per provider and slice: failures that a slice ends with, since the last slice with a success
        order = Window.partitionBy(*self.by).orderBy("_at")
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summary = self._stored("summary", held["slices"], held["sizes"]).withColumn("_island", F.count_if("_clears").over(so_far))
        within = Window.partitionBy(*self.by, "_island").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = summary.withColumn("_out", F.sum("_ends").over(within))
        carried = ends.withColumn("_carried", F.coalesce(F.lag("_out").over(order), F.lit(0)))
        rows = self._stored("rows", held["slices"], held["sizes"])
        joined = rows.join(carried.select(*self.by, "_at", "_carried"), [*self.by, "_at"])
        streak = F.col("_local") + F.when(F.col("_lead") & ~F.col("ok"), F.col("_carried")).otherwise(0)
        opens = ~F.col("ok") & (F.pmod(streak, F.lit(failures)) == 0)
        until = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
        names = [c for c in rows.columns if not c.startswith("_")]
        return joined.select(*names, streak.cast("long").alias("streak"), opens.alias("opens"), F.when(opens, until).alias("open_until"))


def breaker_stream(attempts: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("provider",), slice_by: str = "hour") -> StreamingQuery:
    """Breaker openings in a stream of attempts that ran, in whatever order they come; read with ``Breakers.read``."""

    def each(rows: DataFrame, batch: int) -> None:
        Breakers(rows.sparkSession, path, by, slice_by).apply(batch, rows)

    return _start(attempts, checkpoint, each, "append")
