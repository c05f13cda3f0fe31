import os
import zlib

import numpy as np
import pytest

from enrichspark.llm import quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(given):
    return quality.fit(*given)


def test_votes_are_those_of_all_neighbours(model, given):
    """Each cosine by itself, the nearest sorted out in full."""
    texts = [r.text for r in given[0].limit(60).collect()]
    vectors = model.vectors(quality.term_counts(texts))
    got = model.vote(vectors)
    for v, score in zip(vectors, got):
        near = sorted(((float(np.dot(v, k)), y) for k, y in zip(model.known, model.labels)), reverse=True)
        least = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        voters = [(c, y) for c, y in near if c >= least - 1e-12 and c > 1e-9]
        total = sum(c**8 for c, _ in voters)
        assert abs(score - sum(y * c**8 for c, y in voters) / total) < 1e-6


def test_held_out(given, model):
    docs, labels = given
    scores = {r.id: r.score for r in quality.quality(docs, model).collect()}
    held = [(scores[r.doc_id] >= 0.3, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in scores]
    assert np.mean([p == y for p, y in held]) > 0.95 and len(scores) == 1000


def test_labels_of_held_out_rows_are_never_learned(given):
    """Turned round, they change nothing."""
    from pyspark.sql import functions as F

    docs, labels = given
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert np.array_equal(a.labels, b.labels) and np.array_equal(a.known, b.known)


def test_terms_cover_the_whole_text():
    low, tail = "plain words of the usual kind " * 400, "$$$ !!! ### " * 50
    a, b = quality.term_counts([low, low + tail])
    assert not np.array_equal(a, b) and b.sum() > a.sum()


def test_edge_cases(spark, given, model):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "$$$ %%% &&& " * 30), (None, "x"), (4, "$$$ %%% &&& " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'q' as quality_score", "5 as id")
    got = quality.quality(df, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    blank = {r.id: r.score for r in got}
    assert blank[1] == blank[2] == pytest.approx(model.share)
    kept = quality.keep_good(df, given[1])
    assert kept.columns == df.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.op6_quality_classifier(df, none).collect()} == {0.5}
    assert quality.op6_quality_classifier(df.limit(0), none).count() == 0


def test_one_label_only(spark):
    docs = spark.createDataFrame([(i, f"some words {i} here") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, None) for i in range(20)] + [(None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.op6_quality_classifier(docs, labels).collect()} == {1}
