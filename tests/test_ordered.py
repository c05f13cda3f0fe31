import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from enrichspark.operators import ordered


def hot_groups(rows, n=3000, seed=3):
    """A third of all rows in one group, many rows at the same position."""
    rng = random.Random(seed)
    data = [
        ("hot" if rng.random() < 0.34 else f"g{rng.randrange(6)}", rng.randrange(400), i, rng.randrange(10))
        for i in range(n)
    ]
    return rows(data, "g string, t long, id long, v long")


def test_running_equals_a_plain_window(rows):
    df = hot_groups(rows)
    df = df.withColumn("b", F.floor(F.col("t") / 25))
    w = Window.partitionBy("g").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    peak = F.when(F.col("v") > 7, F.col("t"))
    got = ordered.running(df, ["g"], ["t", "id"], "b", sums={"s": F.col("v")}, maxes={"m": peak})
    want = df.withColumn("s", F.sum("v").over(upto)).withColumn("m", F.max(peak).over(upto))
    cols = ["id", "s", "m"]
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}
    got = ordered.running(df, ["g"], ["t", "id"], "b", sums={"s": F.col("v")}, maxes={"m": peak}, before=True)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(before), F.lit(0))).withColumn("m", F.max(peak).over(before))
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}


def test_numbering_without_groups(rows):
    df = hot_groups(rows, 500).select("id")
    got = ordered.numbered(df, [], ["id"], 7)
    assert sorted((r.id, r.rn) for r in got.collect()) == [(i, i + 1) for i in range(500)]


def test_trailing_blocks_are_exact(rows):
    df = hot_groups(rows)
    numbered = ordered.numbered(df, ["g"], ["t", "id"], 25)
    blocks = ordered.trailing_blocks(numbered, "rn", rows=5, block=16)
    w = Window.partitionBy("g", "_block").orderBy("rn").rowsBetween(-4, 0)
    got = blocks.withColumn("s", F.sum("v").over(w)).where("not _copy").select("id", "s")
    plain = Window.partitionBy("g").orderBy("t", "id").rowsBetween(-4, 0)
    want = df.withColumn("s", F.sum("v").over(plain)).select("id", "s")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_top_one(rows):
    df = hot_groups(rows)
    got = ordered.top_one(df, ["g"], [F.desc("t"), F.asc("id")])
    best = {}
    for r in df.collect():
        if r.g not in best or (-r.t, r.id) < (-best[r.g].t, best[r.g].id):
            best[r.g] = r
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in best.values()}


def test_slices_follow_the_data(rows):
    """A third of all rows in one group at one instant: no slice is large."""
    data = [(i, "hot" if i % 3 == 0 else f"g{i % 50}", 7 if i % 3 == 0 else i) for i in range(6000)]
    df = rows(data, "id long, g string, t long")
    cut = ordered.sliced(df, ["g"], ["t", "id"], 500)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) >= 10 and max(sizes) <= 1000
    got = ordered.numbered(df, ["g"], ["t", "id"], 500).collect()
    want = {}
    for i, g, t in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        want[i] = want.get(("n", g), 0) + 1
        want["n", g] = want[i]
    assert {r.id: r.rn for r in got} == {k: v for k, v in want.items() if not isinstance(k, tuple)}
