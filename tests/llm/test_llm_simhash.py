import itertools
import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from enrichspark.llm import simhash
from test_llm_common import groups

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_fingerprint(text):
    """The definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, "one", "One TWO", "one two three", "a b c d e " * 30, "É é\u00a0x\u2003y z", "x\ty\nz\x0bw\x0cv\ru", " lead and trail ", "\x1fodd\x1c sep\x85x"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) % (1 << 64) == plain_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(random.Random(2).choices("alpha beta gamma delta epsilon".split(), k=2000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 37)
    assert simhash.fingerprint(text, 3) % (1 << 64) == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_index_loses_no_pair(spark):
    """Fingerprints at distances 1 to 5 of each other, crowded around a few centres."""
    rng = random.Random(5)
    marks = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        marks.add(centre)
        for _ in range(40):
            near = centre
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                near ^= 1 << bit
            marks.add(near)
    marks |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1, 7, 1 << 63}
    rows = [(signed(m), i) for i, m in enumerate(sorted(marks))]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    got = [tuple(sorted(r)) for r in simhash.similar_fingerprints(classes).collect()]
    want = [(i, j) for (x, i), (y, j) in itertools.combinations([(m, i) for i, m in enumerate(sorted(marks))], 2) if (x ^ y).bit_count() <= 3]
    assert sorted(got) == sorted(want)


def test_tally_rejects_pairs_that_meet(spark):
    """Fingerprints that share three or four bytes with a centre meet in lists, but do not reach the minimum."""
    rng = random.Random(8)
    marks = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for n in range(60):
            far, near = centre, centre
            for p in rng.sample(range(8), 4 + n % 2):
                far ^= rng.randrange(1, 256) << (8 * p)
            for bit in rng.sample(range(64), 2):
                near ^= 1 << bit
            marks |= {far, near}
    pairs = [(signed(a ^ b),) for a, b in itertools.combinations(marks, 2)]
    x = F.col("x")
    met = F.lit(False)
    for t in simhash.TRIPLES:
        met = met | (x.bitwiseAND(F.lit(simhash._mask(t))) == 0)
    tallied, close = simhash._shared_bytes(x) >= 5, F.bit_count(x) <= 3
    df = spark.createDataFrame(pairs, "x long")
    n = df.select(F.count_if(met).alias("met"), F.count_if(met & tallied).alias("tallied"), F.count_if(met & tallied & close).alias("linked"), F.count_if(close).alias("all")).first()
    assert n.met > n.tallied > n.linked == n["all"] > 0


def plain_groups(docs):
    marks = {i: plain_fingerprint(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(marks, 2) if (marks[a] ^ marks[b]).bit_count() <= 3]
    root = groups(links)
    return {i: (format(m, "016x"), root.get(i, i)) for i, m in marks.items()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_near_dedup(docs).collect()}
    assert got == plain_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "y"), (9, "a b c d", None), (None, "a b c d", "z"), (3, None, "q"), (7, "", "q"), (8, "completely other words", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "fp as id", "fp as component")
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("id", "component").collect()), key=repr)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (None, None), (3, 3), (7, 3), (8, 8)], key=repr)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([5, None, 3, 8], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.similar_fingerprints(spark.createDataFrame([], "fp long, rep long"), bits=4)
