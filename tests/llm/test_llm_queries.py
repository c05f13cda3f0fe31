"""Registered corpus queries beside their SQL twins, and the pipeline beside plain Python."""

import itertools
import os

import check
import pytest

import corpus_pipeline
from enrichspark.llm import decontaminate, quality, registry, toxicity
from test_llm_common import groups
from test_llm_decontaminate import plain_matches
from test_llm_simhash import plain_fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    verdict, note = check.compare(spark, check.connect(SF), name, SF)
    assert verdict == "ok", note


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "toxicity", "simhash near-dedup", "benchmark decontamination", "best-fit packing",
    ]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, given, SF)
        out.append((name, given.collect(), docs.collect(), given.columns, docs.columns))
        if name != "best-fit packing":
            docs = spark.createDataFrame(docs.collect(), given.schema)
    return out


def test_stages_keep_columns(stages):
    for _, _, _, before, after in stages[:-1]:
        assert before == after


def test_filters_equal_plain_models(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for (name, given, kept, _, _), module, good in (
        (stages[0], quality, lambda s: s >= 0.3),
        (stages[1], toxicity, lambda s: s < 0.5),
    ):
        frame = spark.createDataFrame(given)
        model = module.fit(frame, labels)
        want = {r.doc_id for r in given if good(model.score([r.text])[0])}
        assert {r.doc_id for r in kept} == want and len(kept) == len(want), name
        assert 0 < len(want) < len(given) or name == "toxicity"


def test_near_dedup_equals_brute_force(stages):
    _, given, kept, _, _ = stages[2]
    marks = {r.doc_id: plain_fingerprint(r.text) for r in given}
    root = groups([(a, b) for a, b in itertools.combinations(marks, 2) if (marks[a] ^ marks[b]).bit_count() <= 3])
    assert sorted(r.doc_id for r in kept) == sorted(i for i in marks if root.get(i, i) == i) and len(kept) < len(given)


def test_decontamination_equals_brute_force(spark, stages):
    _, given, kept, _, _ = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [r for r in given if len(r.text) < 4000]
    bad = {i for i, _ in plain_matches([(r.doc_id, r.text) for r in short], items)}
    left = {r.doc_id for r in kept}
    assert {r.doc_id for r in short} - left == bad
    exact = {r.doc_id for r in given if any(decontaminate.plain(t) in decontaminate.plain(r.text) for _, t in items if len(t) > 20)}
    assert not exact & left


def test_packing_places_every_byte(stages):
    _, given, rows, _, _ = stages[4]
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in held.items()} == {r.doc_id: len(r.text.encode()) for r in given}


def test_run_equals_its_stages(spark, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, stages[-1][2]))
