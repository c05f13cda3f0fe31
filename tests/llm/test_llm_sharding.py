import hashlib
import os

import pytest

from enrichspark.llm import sharding

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def digest(text, first=0):
    return int(hashlib.md5(text.encode()).hexdigest()[first : first + 12], 16)


def plain_table(shards, slots):
    """Turn after turn."""
    orders = [((digest(s) % slots), digest(s, 12) % (slots - 1) + 1) for s in shards]
    owner, looked, claims = [None] * slots, [0] * len(shards), 0
    while claims < slots:
        i = claims % len(shards)
        offset, step = orders[i]
        while owner[(offset + looked[i] * step) % slots] is not None:
            looked[i] += 1
        owner[(offset + looked[i] * step) % slots] = shards[i]
        claims += 1
    return owner


def table(spark, shards, slots):
    got = {r.slot: r.shard for r in sharding.lookup_table(spark, shards, slots).collect()}
    return [got[i] for i in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 3), (3, 7), (5, 5), (10, 211), (32, 1009)])
def test_table(spark, n, slots):
    shards = [f"node {i}é" for i in range(n)]
    got = table(spark, shards, slots)
    assert got == plain_table(shards, slots)
    held = [got.count(s) for s in shards]
    assert max(held) - min(held) <= 1


def test_losing_a_shard_moves_little(spark):
    shards = [f"s{i}" for i in range(10)]
    before, after = table(spark, shards, 1009), table(spark, shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(before, after) if a != "s9")
    assert moved < 0.15 * 1009


def test_placement(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_table(sharding.SHARDS, sharding.SLOTS)
    got = sharding.op8_sharding(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.slot == digest(str(r.doc_id)) % sharding.SLOTS and r.shard == want[r.slot]


def test_edge_cases(spark):
    rows = [(None, 1), (5, 1), (5, 2), (-3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, slot long").selectExpr("*", "'x' as shard", "0 as at", "1 as id")
    got = sharding.place(docs).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.id == 5}) == 1
    assert {r.slot for r in got if r.id is None} == {digest("") % sharding.SLOTS}
    assert sharding.place(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shards,slots", [(["a", "a"], 7), ([], 7), (["a"], 8), (["a"], 2), (list("abcd"), 3), ([None, "a"], 7)])
def test_refused(spark, shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, shards, slots)


def test_no_python_in_the_plan(spark):
    plan = sharding.op8_sharding(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
