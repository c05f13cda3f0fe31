import os
import random

import pytest
from pyspark.sql import functions as F

from enrichspark.llm import packing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SIZES, COSTS = (8, 16, 32), (10.0, 18.0, 34.0)


def plain_best_fit(lengths):
    """Every open bin looked at for every piece."""
    left, bins, out = sum(lengths), [], []
    for n in lengths:
        open_ = [(size - held, k) for k, (size, held) in enumerate(bins) if size - held >= n]
        if open_:
            _, k = min(open_)
        else:
            _, size = min((c / min(s, max(left, 1)), s) for s, c in zip(SIZES, COSTS) if s >= n)
            k = len(bins)
            bins.append([size, 0])
        out.append((k, bins[k][1]))
        bins[k][1] += n
        left -= n
    final = [min((c, s) for s, c in zip(SIZES, COSTS) if s >= held)[1] for _, held in bins]
    return [(k, final[k], o) for k, o in out]


@pytest.mark.parametrize("seed", range(12))
def test_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([0, 1, 3, 5, 8, 13, 21, 32, rng.randint(1, 32)]) for _ in range(rng.randint(1, 80))), reverse=True)
    assert packing.best_fit(lengths, SIZES, COSTS) == plain_best_fit(lengths)


def test_bins_shrink_to_what_they_hold():
    assert packing.best_fit([5], SIZES, COSTS) == [(0, 8, 0)]
    assert packing.best_fit([20, 12], SIZES, COSTS) == [(0, 32, 0), (0, 32, 20)]


def whole(rows, lengths, sizes):
    """Every token once, no overlap in a bin, no bin over its size."""
    runs, bins = {}, {}
    for r in rows:
        runs.setdefault(r.id, []).append((r.start, r.length))
        bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size and size in sizes
    got = {}
    for i, parts in runs.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        got[i] = at
    assert got == lengths


@pytest.mark.parametrize("pack_rows", [4096, 50])
def test_documents(spark, pack_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    rows = packing.pack(docs, pack_rows=pack_rows).collect()
    whole(rows, lengths, {2048, 4096, 8192})
    filled = sum(r.length for r in rows) / sum({r.bin_id: r.capacity for r in rows}.values())
    assert filled > (0.97 if pack_rows > 50 else 0.85)
    again = packing.pack(docs.repartition(5), pack_rows=pack_rows).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edge_cases(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "x" * 9000), (4, "é" * 5000), (4, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as length", "3 as pack")
    got = packing.pack(docs).collect()
    assert sorted((r.id, r.piece, r.length) for r in got if r.id is not None) == sorted(
        [(1, 0, 3), (2, 0, 0), (3, 0, 0)] + 2 * [(4, 0, 8192), (4, 1, 1808)]
    )
    assert sorted((r.piece, r.length) for r in got if r.id is None) == [(0, 8192), (1, 808)]
    assert packing.pack(docs.limit(0)).count() == 0
    assert sum(r.tokens for r in packing.bins(packing.pack(docs)).collect()) == 3 + 9000 + 20000


def test_own_lengths_and_costs(spark):
    docs = spark.createDataFrame([(i, i) for i in range(1, 40)], "doc_id long, tokens long")
    got = packing.pack(docs, length=F.col("tokens"), sizes=(16, 32), costs=(16.0, 40.0)).collect()
    whole(got, {i: i for i in range(1, 40)}, {16, 32})
