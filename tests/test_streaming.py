"""Streams cut into several micro-batches against their batch operators."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from enrichspark.operators import health, telemetry
from enrichspark.sources import sinks
from enrichspark.sources.derived import Derived, rung_events, telemetry_deltas
from enrichspark.streaming import twins

from conftest import SF


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in time order, four files that arrive one after the other."""
    root = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = ["2023-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2025-01-01"]
    for i in range(4):
        piece = root / f"piece{i}"
        ts = F.col("ts")
        lo, hi = (F.lit(c).cast("timestamp_ntz") for c in cuts[i : i + 2])
        events.where((ts >= lo) & (ts < hi)).coalesce(1).write.parquet(str(piece))
        name = next(f for f in os.listdir(piece) if f.endswith(".parquet"))
        os.link(piece / name, root / f"part{i}.parquet")
        os.utime(root / f"part{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    return str(root), events


@pytest.fixture()
def stream(spark, parts):
    root, events = parts
    return twins.read_stream(spark, root, events.schema, "part*.parquet", files=1)


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def test_pool_month(spark, parts, stream, tmp_path):
    q = twins.write_batches(twins.pool_month(rung_events(stream)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    same(twins.newest_rows(spark, str(tmp_path / "out"), ["rung", "month"]), telemetry.free_pool_month(rung_events(parts[1])))


def test_rung_windows(spark, parts, stream, tmp_path):
    q = twins.write_batches(twins.rung_windows(rung_events(stream), size="6 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = twins.newest_rows(spark, str(tmp_path / "out"), ["window_start", "waterfall", "rung"])
    batch = rung_events(parts[1]).groupBy(F.window("ts", "6 hours").alias("w"), "waterfall", "rung")
    batch = batch.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"))
    batch = batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "waterfall", "rung", "attempts", "successes")
    same(got.drop("avg_latency_ms"), batch)


def test_telemetry(spark, parts, stream, tmp_path):
    twins.fold_stream(telemetry_deltas(rung_events(stream)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = twins.folded(spark, str(tmp_path / "out"))
    want = telemetry.fold_telemetry(telemetry_deltas(rung_events(parts[1])))
    hits = lambda df: {(r.run_id, r.entity_name): r.rung_hits for r in df.collect()}
    assert hits(got) == hits(want)
    same(got.drop("rung_hits", "usd_spent"), want.drop("rung_hits", "usd_spent"))


def attempts(events):
    return events.select("event_id", "ts", F.col("event_type").alias("provider"), F.pmod("user_id", F.lit(6)).alias("run_id"), (F.col("value") >= 40).alias("ok"))


def one_by_one(spark, frames, path):
    """A stream that takes each frame as a file and micro-batch of its own, in the given order."""
    for i, df in enumerate(frames):
        piece = f"{path}-{i}"
        df.coalesce(1).write.parquet(piece)
        os.makedirs(path, exist_ok=True)
        name = next(f for f in os.listdir(piece) if f.endswith(".parquet"))
        os.link(f"{piece}/{name}", f"{path}/part{i}.parquet")
        os.utime(f"{path}/part{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    return twins.read_stream(spark, path, frames[0].schema, files=1)


def test_breaker_in_any_order(spark, parts, tmp_path):
    """Files in shuffled time order, each with rows of many hours: late rows change streaks that were carried on."""
    log = attempts(parts[1])
    for name, frames in (
        ("shuffled", [log.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i) for i in (3, 1, 4, 0, 2)]),
        ("backwards", [log.where(F.floor((F.dayofmonth("ts") - 1) / 8) == i) for i in (3, 2, 1, 0)]),
    ):
        out = str(tmp_path / name)
        twins.breaker_stream(one_by_one(spark, frames, f"{out}-src"), out, f"{out}-ck", slice_by="day").awaitTermination()
        same(twins.Breakers(spark, out, slice_by="day").read(), health.breaker(log))


def test_breaker_retries_and_repeats_change_nothing(spark, rows, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def log(*some):
        data = [(i, t0 + dt.timedelta(minutes=30 * i), "p", ok) for i, ok in some]
        return rows(data, "event_id long, ts timestamp_ntz, provider string, ok boolean")

    store = twins.Breakers(spark, str(tmp_path / "b"))
    assert store.read() is None
    store.apply(0, log((0, False), (5, False), (9, False)))
    store.apply(1, log((3, False), (5, False)))  # one late, one seen before
    store.apply(1, log((4, True)))  # the same batch once more: done already
    got = {r.event_id: (r.streak, r.opens) for r in store.read().collect()}
    assert got == {0: (1, False), 3: (2, True), 5: (3, False), 9: (4, True)}
    store.apply(2, log((4, True)))
    got = {r.event_id: (r.streak, r.opens) for r in store.read().collect()}
    assert got == {0: (1, False), 3: (2, True), 4: (0, False), 5: (1, False), 9: (2, True)}


def test_levels_read_few_runs_and_survive_retries(spark, parts, tmp_path):
    deltas = telemetry_deltas(rung_events(parts[1]))
    n = 11
    ids = parts[1].agg(F.max("event_id") + 1).first()[0]
    store = twins.telemetry_levels(spark, str(tmp_path / "levels"))
    assert store.read() is None and store.last() == -1
    for i in range(n):
        some = telemetry.fold_telemetry(deltas.where(F.floor(F.col("seq") * n / ids) == i))
        if i == 5:  # an attempt that failed before its manifest leaves a folder behind
            some.limit(1).write.parquet(f"{tmp_path}/levels/runs/{i:012d}-{i:012d}")
        store.apply(i, some)
        store.apply(i, some.limit(3))  # tried again after it stood
        assert len(store.runs()) <= 1 + math.log2(i + 1) and store.last() == i
    same(store.read().drop("rung_hits", "usd_spent"), telemetry.fold_telemetry(deltas).drop("rung_hits", "usd_spent"))
    kept = os.listdir(tmp_path / "levels" / "runs")
    assert len(kept) <= 4 * 3  # what the last manifests name, no more


def test_rung_windows_count_rows_in_any_order(spark, tmp_path):
    """Newest files first, one per micro-batch: nothing is late."""
    events = Derived(spark, SF).given("events")
    src = str(tmp_path / "src")
    days = [r.d for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy(F.desc("d")).limit(4).collect()]
    for day in days:
        events.where(F.to_date("ts") == F.lit(day)).coalesce(1).write.mode("append").parquet(src)
    stream = twins.read_stream(spark, src, events.schema, files=1)
    out = str(tmp_path / "out")
    twins.write_batches(twins.rung_windows(rung_events(stream)), out, str(tmp_path / "ck")).awaitTermination()
    got = twins.newest_rows(spark, out, ["window_start", "waterfall", "rung"]).agg(F.sum("attempts")).first()[0]
    assert got == events.where(F.to_date("ts").isin(days)).count()


def test_watchdog(spark, tmp_path):
    d = Derived(spark, SF.replace("sf0.001", "sf0.01"))
    cols = ["run_id", "entity_name", "created_at", "verified_fields", "unverified_fields"]
    tel = d.entity_telemetry.select(*cols)
    source = str(tmp_path / "src")
    tel.repartition(5).write.parquet(source)
    state = str(tmp_path / "state")
    stream = twins.read_stream(spark, source, tel.schema, files=1)
    q = twins.watchdog_stream(stream, state, str(tmp_path / "ck"), window=10)
    q.awaitTermination()
    last = twins.last_state(spark, q, state)
    assert last.count() == 60
    same(telemetry.watchdog(last, d.run, 10), telemetry.watchdog(tel, d.run, 10))


def plain_misses(batches, days):
    """Requests one by one, in the order of batches and of time within each."""
    expires, out = {}, []
    for batch in batches:
        for key, ts in sorted(batch, key=lambda r: r[1]):
            if key not in expires or ts >= expires[key]:
                out.append((key, ts))
                expires[key] = ts + dt.timedelta(days=days)
    return sorted(out, key=repr)


def test_fresh_keys_over_lifetimes(spark, rows, tmp_path):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    batches = []
    for start in (0, 20, 45, 47, 100, 60):  # one spans lifetimes, the last comes late
        span = 70 if start == 47 else 18
        keys = ["hot"] * 30 + [f"k{rng.randrange(12)}" for _ in range(25)] + [None]
        batches.append([(k, t0 + dt.timedelta(days=start, minutes=rng.randrange(span * 1440))) for k in keys])
    batches[1] += [("edge", t0 + dt.timedelta(days=20)), ("edge", t0 + dt.timedelta(days=50))]  # gone as it expires
    batches[2] += [("edge", t0 + dt.timedelta(days=49, hours=23))]
    frames = [rows(b, "url_key string, ts timestamp_ntz") for b in batches]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = one_by_one(spark, frames, str(tmp_path / "src"))
    twins.fresh_keys(stream, out, state, str(tmp_path / "ck"), late_days=365).awaitTermination()
    got = sorted(((r.url_key, r.ts) for r in spark.read.parquet(out).collect()), key=repr)
    assert got == plain_misses(batches, 30) and len(got) > 40


def test_fresh_keys_forget_the_gone(spark, rows, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    frames = [rows([(f"k{i}", t0 + dt.timedelta(days=40 * i))], "url_key string, ts timestamp_ntz") for i in range(6)]
    state = str(tmp_path / "state")
    stream = one_by_one(spark, frames, str(tmp_path / "src"))
    twins.fresh_keys(stream, str(tmp_path / "out"), state, str(tmp_path / "ck")).awaitTermination()
    store = twins.Levels(spark, state, lambda rows: rows.groupBy("url_key").agg(F.max("expires").alias("expires")))
    assert store.last() == 5 and store.read().count() < 4


def test_event_append_restarts_without_repeats(spark, parts, tmp_path):
    root, events = parts
    for _ in range(2):
        stream = twins.read_stream(spark, root, events.schema, "part*.parquet", files=2)
        sinks.stream_events(rung_events(stream), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()
