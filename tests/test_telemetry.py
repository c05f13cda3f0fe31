import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from enrichspark.operators import telemetry as T

AS_OF = "2024-02-01 00:00:00"
T0 = dt.datetime(2024, 1, 1)
TEL = "run_id string, entity_name string, created_at timestamp_ntz, verified_fields long, unverified_fields long"


def entities(rows, per_run):
    return rows(
        [
            (run, f"e{i:04d}", T0 + dt.timedelta(minutes=i), v, u)
            for run, pairs in per_run.items()
            for i, (v, u) in enumerate(pairs)
        ],
        TEL,
    )


@pytest.fixture()
def runs(rows):
    data = [(r, "running", None) for r in "abcde"] + [("f", "done", None), ("g", "running", None)]
    return rows(data, "run_id string, status string, paused_reason string")


@pytest.fixture()
def tel(rows):
    good, bad, none = (1, 0), (0, 1), (0, 0)
    return entities(
        rows,
        {
            "a": [good] * 30,
            "b": [good] * 100 + [bad] * 12 + [good] * 13,
            "c": [good] * 100 + [bad] * 11 + [good] * 14,
            "d": [bad] * 24,
            "e": [none] * 30,
            "f": [bad] * 30,
        },
    )


def test_watchdog(tel, runs):
    got = {r.run_id: r for r in T.watchdog(tel, runs).collect()}
    assert not got["a"].paused and got["a"].rate == 1.0 and got["a"].entities == 25
    assert got["b"].paused and got["b"].reason == "verified-rate 0.52 < 0.55 over trailing 25 entities"
    assert got["b"].status == "paused"
    assert not got["c"].paused and got["c"].rate == 0.56
    assert not got["d"].paused and got["d"].entities == 24
    assert got["e"].rate is None and got["e"].entities == 0 and not got["e"].paused
    assert got["f"].paused and got["f"].status == "done"
    assert got["g"].rate is None and got["g"].status == "running"
    assert {r.run_id for r in T.watchdog(tel, runs, window=0).where("paused").collect()} == {"b", "f"}
    assert not T.watchdog(tel, runs, min_rate=0.5).where("paused and run_id = 'b'").count()


def test_pause_changes_running_runs_only(tel, runs):
    after = {r.run_id: (r.status, r.paused_reason) for r in T.pause_runs(runs, T.watchdog(tel, runs)).collect()}
    assert after["b"][0] == "paused" and after["b"][1].startswith("verified-rate 0.52")
    assert after["f"] == ("done", None) and after["a"] == ("running", None)


def test_watchdog_limits_rows_ahead_of_the_shuffle(tel):
    plan = T.trailing_rate(tel)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_trail_equals_plain_loops(rows):
    rng = random.Random(1)
    pairs = {"hot": [(rng.randrange(3), rng.randrange(3)) for _ in range(300)], "b": [(0, 0), (1, 1)]}
    got = T.watchdog_trail(entities(rows, pairs), window=25, slice_rows=30, block=40).collect()
    want = {}
    for run, seq in pairs.items():
        for i in range(len(seq)):
            part = seq[max(0, i - 24) : i + 1]
            v, u = sum(p[0] for p in part), sum(p[1] for p in part)
            want[(run, i + 1)] = round(v / (v + u), 9) if v + u else None
    assert {(r.run_id, r.nth): None if r.rate is None else round(r.rate, 9) for r in got} == want


def deltas(rows, data):
    schema = (
        "run_id string, entity_name string, seq long, created_at timestamp_ntz, credits_spent long, entity_domain string, "
        "internal_status string, duration_ms long, rung_hits map<string,long>"
    )
    return rows([("r", e, s, T0 + dt.timedelta(seconds=s), c, d, st, ms, h) for e, s, c, d, st, ms, h in data], schema)


DELTAS = [
    ("x", 1, 2, "a.com", None, 5, {"jina": 1, "native": 1}),
    ("x", 2, None, None, "customer", None, {"jina": 7}),
    ("x", 3, 1, "b.com", None, None, {}),
    ("y", 4, 0, None, None, None, None),
]


def plain_fold(data):
    """Deltas of one entity one by one: counters add, the rest is overwritten by what is known."""
    out = {}
    for e, s, credits, domain, status, ms, hits in sorted(data, key=lambda d: d[1]):
        row = out.setdefault(e, [0, None, None, None, {}])
        row[0] += credits or 0
        for i, v in ((1, domain), (2, status), (3, ms)):
            row[i] = row[i] if v is None else v
        row[4].update(hits or {})
    return out


def test_fold_equals_plain_walk(rows):
    rng = random.Random(5)
    data = []
    for s in range(600):
        hits = rng.choice([None, {}, {rng.choice("abc"): rng.randrange(9)}, {r: rng.choice([None, s]) for r in "abcd"}])
        entity = "hot" if rng.random() < 0.4 else f"e{rng.randrange(20)}"
        text = [rng.choice([None, f"{rng.randrange(9)}"]) for _ in range(2)]
        data.append((entity, s, rng.choice([None, 0, 1, 5]), *text, rng.choice([None, 3, 4]), hits))
    got = T.fold_telemetry(deltas(rows, data)).collect()
    fields = ("credits_spent", "entity_domain", "internal_status", "duration_ms", "rung_hits")
    assert {r.entity_name: [r[f] for f in fields] for r in got} == plain_fold(data) and len(got) == 21


def test_fold(rows):
    got = {r.entity_name: r for r in T.fold_telemetry(deltas(rows, DELTAS)).collect()}
    x = got["x"]
    assert (x.credits_spent, x.entity_domain, x.internal_status, x.duration_ms) == (3, "b.com", "customer", 5)
    assert x.rung_hits == {"jina": 7, "native": 1} and x.created_at == T0 + dt.timedelta(seconds=1)
    assert got["y"].rung_hits == {} and got["y"].entity_domain is None


@pytest.mark.parametrize("cut", [0, 1, 2, 3, 4])
def test_upsert_equals_one_fold(rows, cut):
    whole = T.fold_telemetry(deltas(rows, DELTAS))
    state = T.fold_telemetry(deltas(rows, DELTAS[:cut]))
    got = T.upsert_telemetry(state, deltas(rows, DELTAS[cut:])).select(*whole.columns)
    as_set = lambda df: {r.entity_name: r.asDict() for r in df.collect()}
    assert as_set(got) == as_set(whole)


def test_rates_and_costs(rows, runs):
    tel = rows(
        [("a", 1, 1, 2, 0.5, 10, 5, 3, 1), ("a", 2, 0, 1, 0.25, 1, 1, 1, 0), ("b", 0, 0, 0, 0.0, 0, 0, 0, 0)],
        "run_id string, verified_fields long, unverified_fields long, credits_spent long, usd_spent double, tokens_in long, "
        "tokens_out long, orchestrator_turns long, cache_hits long",
    )
    rates = {r.run_id: (r.verified_rate, r.entities) for r in T.verified_rate(tel).collect()}
    assert rates == {"a": (0.75, 2), "b": (None, 1)}
    split = {r.run_id: r for r in T.cost_split(runs.withColumn("model", F.lit("m")), tel).collect()}
    assert set(split) == {"a", "b"} and split["a"].orchestrator_tokens == 17 and split["a"].api_usd == 0.75
    runs = runs.withColumn("finished_at", F.lit(None).cast("timestamp_ntz")).withColumn("verified_rate", F.lit(None).cast("double"))
    done = {r.run_id: r for r in T.finish_runs(runs, tel, AS_OF, "aborted").collect()}
    assert done["a"].verified_rate == 0.75 and done["g"].verified_rate is None
    assert {r.status for r in done.values()} == {"aborted"}


def test_pools_and_budgets(rows):
    events = rows(
        [("tavily", "free", T0)] * 1001 + [("cache", "free", T0 + dt.timedelta(days=40)), ("x", "gated", T0)],
        "rung string, tier string, ts timestamp_ntz",
    )
    burn = T.free_pool_month(events)
    assert {(r.rung, r.month.month, r.calls) for r in burn.collect()} == {("tavily", 1, 1001), ("cache", 2, 1)}
    status = {(r.rung, r.month.month): r for r in T.budget_status(burn).collect()}
    assert len(status) == 12
    assert status[("tavily", 1)].over_budget and status[("tavily", 1)].remaining == -1
    assert status[("brave", 2)].calls == 0 and not status[("jina", 1)].over_budget


def test_tiers_and_saving(rows):
    """The published worked example: 3,000 operations in three tiers."""
    data = [("free", 0, "0")] * 2640 + [("credit", 1, "0")] * 330 + [("gated", 0, "0.005")] * 30
    events = rows(data, "tier string, cost_credits long, usd string").withColumn("cost_usd", F.col("usd").cast("decimal(18,6)"))
    got = {r.tier: r for r in T.tier_costs(events).collect()}
    assert [round(got[t].share, 2) for t in ("free", "credit", "gated")] == [0.88, 0.11, 0.01]
    assert round(got["total"].cost_low, 6) == 0.15 and round(got["total"].cost_high, 6) == 1.8
    saved = T.saving(events).first()
    assert saved.ops == 3000 and round(saved.baseline, 6) == 15.0 and round(saved.ratio, 4) == round(15 / 1.8, 4)


def test_lifecycle(rows):
    new = T.create_runs(rows([("r1", "haiku"), ("r2", None)], "run_id string, model string"), AS_OF).collect()
    assert [(r.model, r.status, r.entity_type, r.entity_count) for r in new] == [
        ("haiku", "running", "company", 0),
        ("sonnet", "running", "company", 0),
    ]
    df = rows([("r1", 1), ("r2", 2), ("r1", 3)], "run_id string, x int")
    assert {r.x for r in T.drop_runs(df, rows([("r1",)], "run_id string")).collect()} == {2}
    assert [(r.run_id, r["rows"]) for r in T.duplicates(df, ["run_id"]).collect()] == [("r1", 2)]
