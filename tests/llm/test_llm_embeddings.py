import math
import os

import numpy as np
import pytest

from enrichspark.llm import embeddings
from test_llm_common import groups

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, least=0.95):
    """Every pair compared."""
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = []
    for a in sound:
        for b in sound:
            if a < b and len(sound[a]) == len(sound[b]):
                if sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= least:
                    links.append((a, b))
    root, n = groups(links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return {i: (n.get(i, 0), root.get(i, i) if i is not None else None) for i, _ in rows}


def found(df, **options):
    return {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("cells,tiles", [(2048, 2048), (60, 7), (20, 50)])
def test_equals_all_pairs(spark, cells, tiles):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(2)
    near = [(1000 + k, (np.array(rows[k % 50][1]) + rng.normal(0, 0.02, 64)).tolist()) for k in range(200)]
    rows += near
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(df, cell_rows=cells, tile_rows=tiles)
    assert got == plain(rows) and max(n for n, _ in got.values()) > 2


@pytest.mark.parametrize("least", [0.3, 0.99])
def test_other_thresholds(spark, least):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 5))
    rows = [(i, (base[i % 30] + 0.2 * rng.normal(size=5)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, least=least, cell_rows=16, tile_rows=9) == plain(rows, least)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [5.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as id", "1 as vector", "1 as cell")
    got = found(df)
    want = plain([r for r in rows])
    assert got == want and got[2] == (1, 1) and got[10] == (1, 9) and got[None] == (0, None)
    out = {r.vec_id: r.kept for r in embeddings.op5_embedding_near_dedup(df).collect()}
    assert out[1] and not out[2] and out[3] and out[None] is False


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.op5_embedding_near_dedup(df).count() == 0


def test_cells_are_cut_into_bounded_tiles(spark):
    """A third of all vectors are one crowd; no task gets more than two tiles."""
    rng = np.random.default_rng(4)
    crowd = rng.normal(size=8)
    rows = [(i, (crowd + 0.01 * rng.normal(size=8) if i % 3 == 0 else rng.normal(size=8)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    placed = embeddings.assign(df, [r[1] for r in rows[:10]], math.sqrt(0.1))
    sizes = embeddings.tiled(placed, 64).groupBy("cell", "a", "b").count().agg({"count": "max"}).first()[0]
    assert sizes <= 2 * 64 * 1.6
