import os
import random

import numpy as np
import pytest

from enrichspark.llm import decontaminate as dec

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def least_edits(passage, text):
    """Fewest edits of a passage anywhere in a text (Sellers)."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text], int)
    for i, c in enumerate(passage, 1):
        diagonal = row[:-1] + (codes != ord(c))
        new = np.concatenate([[i], np.minimum(diagonal, row[1:] + 1)])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def plain_matches(docs, items, q=8, share=1 / 12):
    out = {}
    index = dec.Passages(items, q, share)
    for i, text in docs:
        words = dec.plain(text)
        for j, passage, k in zip(index.ids, index.texts, index.edits):
            e = least_edits(passage, words)
            if e <= k:
                out[i, j] = e
    return out


def edited(text, n, rng):
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcxyz") + (text[at:] if kind == 1 else text[at + 1 :])) if kind else text[:at] + text[at + 1 :]
    return text


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:25]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    docs = [(i, t[:3000]) for i, t in docs]
    out = []
    for n, (i, t) in enumerate(docs):
        words = t.split(" ")
        if n % 2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [edited(rng.choice(items)[1], rng.choice([0, 1, 4, 9, 14, 18, 22, 40]), rng)]
        out.append((i, " ".join(words)))
    return out, items


def test_equals_alignment_of_everything(spark, planted):
    docs, items = planted
    got = dec.benchmark_matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = plain_matches(docs, items)
    assert {(r.id, r.item): r.edits for r in got} == want and len(want) > 20
    texts, passages = dict(docs), dict(items)
    for r in got:
        span = dec.plain(texts[r.id][r.start : r.stop])
        assert least_edits(dec.plain(passages[r.item]), span) <= r.edits + 1


def test_blocks_of_passages(spark, planted):
    docs, items = planted
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, dec.benchmark_matches(d, b).collect()))
    assert sorted(map(tuple, dec.benchmark_matches(d, b, block_chars=1000).collect())) == one


def test_batches_do_not_matter(monkeypatch, planted):
    docs, items = planted
    index = dec.Passages(items, 8, 1 / 12)
    texts = [t for _, t in docs]
    whole = sorted(index.search(texts))
    assert whole == sorted((n, *r[1:]) for n, t in enumerate(texts) for r in index.search([t]))
    for spread in (1, 50, 5000):  # each item alone, and in runs of its places
        monkeypatch.setattr(dec, "SPREAD", spread)
        assert sorted(index.search(texts)) == whole


def test_common_grams_are_laid_out_in_bounded_runs(monkeypatch):
    """A text of one character over passages of that character: meetings are the product of their lengths."""
    laid = []
    real = dec.ranges
    monkeypatch.setattr(dec, "SPREAD", 1 << 12)
    monkeypatch.setattr(dec, "ranges", lambda first, n: laid.append(int(n.sum())) or real(first, n))
    index = dec.Passages([(i, "a" * 100 + f" end {i}") for i in range(20)], 8, 1 / 12)
    item, _ = index.regions(dec.gram_codes(dec.characters("a" * 500), 8))
    assert max(laid) <= dec.SPREAD and sum(laid) > 100 * dec.SPREAD and set(item.tolist()) == set(range(20))
    assert (7, 0) in [(r[1], r[2]) for r in index.search([f"so {'a' * 100} end 7"])]


def test_ids_of_any_type(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards boxed"
    d = spark.createDataFrame([("a-1", passage), ("b-2", "no such thing"), (None, passage)], "doc_id string, text string")
    b = spark.createDataFrame([("mmlu/7", passage)], "item_id string, text string")
    assert [tuple(r)[:3] for r in dec.benchmark_matches(d, b).collect()] == [("a-1", "mmlu/7", 0)]
    assert [r.doc_id for r in dec.decontaminate(d, b).collect()] == ["b-2"]


def test_very_long_texts_and_clashing_names(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards boxed"
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, f"{long} {passage} {long}"), (2, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "true as holds_passage", "3 as `Id`", "4 as `a.b`")
    b = spark.createDataFrame([(10, passage)], "item_id long, text string").selectExpr("*", "1 as words", "2 as item")
    assert [(r.id, r.edits) for r in dec.benchmark_matches(d, b).collect()] == [(1, 0)]
    kept = dec.decontaminate(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_edge_cases(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards boxed"
    docs = [
        (1, f"Intro. {passage.upper().replace(' ', ', ')}! End."), (2, None), (3, ""), (4, "nothing of the kind"), (None, passage),
        (5, passage), (5, passage), (6, f"{passage} {passage}"), (7, passage[:40]), (8, "  " + passage.replace("wizards", "wizzards")),
    ]
    items = [(10, passage), (10, passage), (11, None), (12, ""), (13, "short"), (None, passage), (14, "!!!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as item", "1 as id", "2 as start")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.id, r.item, r.edits) for r in dec.benchmark_matches(d, b).collect())
    assert got == [(1, 10, 0), (5, 10, 0), (6, 10, 0), (8, 10, 1)]
    kept = dec.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dec.benchmark_matches(d, nothing).count() == 0 and dec.decontaminate(d, nothing).count() == len(docs)
    assert dec.benchmark_matches(d.limit(0), b).count() == 0
    assert dec.contaminated(dec.benchmark_matches(d, b)).filter("id = 6 and n_items = 1").count() == 1


def test_budget_must_leave_a_shared_gram(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        dec.benchmark_matches(empty, empty, item_key="doc_id", q=10, max_edit_share=0.1)
