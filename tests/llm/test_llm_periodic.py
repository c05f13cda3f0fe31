"""Runs of words beside plain search over all periods, and Lyndon arrays by their definition."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from enrichspark.llm import periodic

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string"


def plain_runs(s, least, words=1):
    out = []
    for p in range(1, len(s) // least + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            a = i
            while i + p < len(s) and s[i] == s[i + p]:
                i += 1
            n = i - a + p
            if n >= max(words, least * p) and not any(all(s[a + k] == s[a + k + q] for k in range(n - q)) for q in range(1, p)):
                out.append((a, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(s):
    """Up to the next smaller suffix."""
    ends = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) for i in range(len(s))]
    return [j - i for i, j in enumerate(ends)]


def sequences():
    rng = random.Random(5)
    for _ in range(600):
        n, k = rng.randrange(41), rng.choice([1, 2, 3, 6])
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        yield s
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b  # a Fibonacci word is full of runs


def test_lyndon_arrays_and_runs():
    for s in sequences():
        _, ranks = np.unique(s, return_inverse=True)
        for order in (ranks, ranks.max(initial=0) - ranks):
            order = order.tolist()
            length, group = periodic.grouped(order)
            assert length == plain_lyndon(order)
            roots = [tuple(order[i : i + n]) for i, n in enumerate(length)]
            assert len({*zip(roots, group)}) == len({*roots}) == len({*group})
        for least in (2, 3, 4):
            assert periodic.runs(s, least) == plain_runs(s, least)
        assert periodic.long_runs(np.array(s, np.int64)) == plain_runs(s, 4, 6)


@pytest.mark.parametrize("n", [1, 5, 6, 40000])
def test_one_word_again_and_again(n):
    assert periodic.long_runs(np.zeros(n, np.int64)) == ([(0, n, 1)] if n >= 6 else [])


def test_long_stretches():
    rng = np.random.default_rng(1)
    block = rng.integers(0, 500, 3000)
    words = np.concatenate([rng.integers(0, 500, 777), np.tile(block, 5), block[:100], [999], np.tile([1, 2], 4), [3]])
    runs = [r for r in periodic.long_runs(words) if r[1] > 12000]
    start, length, p = runs[0]
    assert len(runs) == 1 and p == 3000 and start <= 777 and start + length >= 777 + 15100
    assert (777 + 15101, 8, 2) in [(max(a, 777 + 15101), n, q) for a, n, q in periodic.long_runs(words)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words, 4, 6)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    from fractions import Fraction

    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000")
    rows = docs.select("doc_id", "text").collect()
    extra = [
        (10**9 + i, t)
        for i, t in enumerate(
            [None, "", " \n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "a a a a a a a a a a a a z", "\x1c \x1c \x1c \x1c \x1c \x1c"]
            + ["b " * 20 + "c d " * 5 + "e f g " * 4 + "e"] * 30
            + ["one two three four five six seven eight nine ten eleven twelve"] * 30
        )
    ]
    frame = spark.createDataFrame([*map(tuple, rows), *extra, extra[20], (None, "q " * 9), (-5, "q r " * 9)], SCHEMA)
    given = frame.selectExpr("*", "1 as id", "'x' as numbered", "2 as `a.b`", "3 as period")
    got = periodic.op12_periodic_runs(given)
    want = sorted((expected(r.doc_id, r.text) for r in frame.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(w[1] for w in want) > 60 and got.columns[:2] == ["doc_id", "n_runs"]
    assert periodic.op12_periodic_runs(given.limit(0)).count() == 0


def test_texts_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a b " * 5), (2, None)], SCHEMA)
    got = {r.id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic.periodic_runs(docs).collect()}
    assert got == {1: (1, 0, 10, 2, 5000), 2: (0, None, None, None, None)}
