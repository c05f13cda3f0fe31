import datetime as dt
import random

from enrichspark.operators import health

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, provider string, ok boolean, status int"


def attempts(rows, n=1500, seed=5):
    rng = random.Random(seed)
    out, t = [], START
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, 60, 400, 4000]))
        ok = rng.random() < 0.5
        out.append((i, t, "hot" if rng.random() < 0.6 else f"p{rng.randrange(3)}", ok, 200 if ok else rng.choice([429, 432, 500])))
    return out, rows(out, SCHEMA)


def test_breaker_equals_a_sequential_count(rows):
    data, df = attempts(rows)
    fails, want = {}, {}
    streaks = {}
    for i, ts, p, ok, _ in data:
        if ok:
            fails[p] = streaks[p] = 0
            want[i] = (0, False)
            continue
        fails[p] = fails.get(p, 0) + 1
        streaks[p] = streaks.get(p, 0) + 1
        opened = fails[p] >= 2
        if opened:
            fails[p] = 0
        want[i] = (streaks[p], opened)
    got = health.breaker(df.drop("status"), slice_rows=100).collect()
    assert {r.event_id: (r.streak, r.opens) for r in got} == want
    assert all((r.open_until == r.ts + dt.timedelta(seconds=120)) if r.opens else r.open_until is None for r in got)


def test_cooldowns_merge(rows):
    data, df = attempts(rows)
    want = {}
    for _, ts, p, _, status in data:
        if status not in (429, 432, 433):
            continue
        spans = want.setdefault(p, [])
        end = ts + dt.timedelta(seconds=3600)
        if spans and ts < spans[-1][1]:
            spans[-1] = (spans[-1][0], end, spans[-1][2] + 1)
        else:
            spans.append((ts, end, 1))
    got = {}
    for r in health.cooldowns(df, slice_rows=90).collect():
        got.setdefault(r.provider, []).append((r.cooling_from, r.cooling_until, r.trips))
    assert {p: sorted(s) for p, s in got.items()} == want


def test_batches_hold_at_most_twenty(rows):
    import hashlib

    keys = [(hashlib.sha256(str(i % 900).encode()).hexdigest(),) for i in range(2000)]
    got = health.assign_batches(rows(keys, "url_key string")).collect()
    assert len(got) == 900
    sizes = {}
    for r in got:
        sizes[(r.batch_bucket, r.batch_no)] = sizes.get((r.batch_bucket, r.batch_no), 0) + 1
    assert max(sizes.values()) == 20
    assert len(sizes) < 900 / 20 + 16 + 1
