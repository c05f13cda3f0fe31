import os

import numpy as np
import pytest

from enrichspark.llm import language

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs, rows=500)


def test_gradients_of_one_cell():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(0)
    h, codes = 3, rng.integers(0, 256, (5, 2))
    cell = language.Cell(rng.normal(size=(256, 3 * h)), rng.normal(size=(h, 3 * h)))
    weight = rng.normal(size=(5, 2, h))

    def loss():
        return float((language._run(cell, codes)[0][1:] * weight).sum())

    states, tape = language._run(cell, codes)
    grads = language._back(cell, codes, states, tape, weight)
    for param, grad in zip((cell.inputs, cell.states), grads):
        for at in [(codes[2, 1], 4), (codes[0, 0], 7)] if param is cell.inputs else [(0, 1), (2, 8), (1, 5)]:
            kept = param[at]
            param[at] = kept + 1e-5
            up = loss()
            param[at] = kept - 1e-5
            down = loss()
            param[at] = kept
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_fast_step_is_the_trained_cell():
    rng = np.random.default_rng(1)
    cell = language.Cell(rng.normal(size=(256, 12)), rng.normal(size=(4, 12)))
    codes = rng.integers(0, 256, (9, 3))
    want = language._run(cell, codes)[0][-1]
    state = np.zeros((4, 3), np.float32)
    for row in codes:
        language.step(language.turned(cell), row, state)
    assert np.allclose(state.T, want, atol=1e-4)


def test_held_out_accuracy(docs, model):
    rows = language.languages(docs, model).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    import zlib

    held = [r for r in rows if zlib.crc32(str(r.id).encode()) % 3 == 1]
    assert np.mean([r.lang_pred == truth[r.id] for r in held]) > 0.95 and len(rows) == 1000


def test_neighbours_in_a_batch_do_not_matter(docs, model):
    texts = [r.text for r in docs.limit(40).collect()] + ["é", "kurz", None]
    names, scores = model.predict(texts)
    for t, n, s in list(zip(texts, names, scores))[::6]:
        one, score = model.predict([t])
        assert one == [n] and abs(score[0] - s) < 1e-4


def test_every_byte_counts(model):
    """The mean over a long text is that of its segments."""
    a, b = "the and of in to " * 8, "und der die das ist " * 7
    span = language.SPAN
    a, b = a[:span], b[:span]
    both = model.probabilities([(a + b).encode()])[0]
    parts = model.probabilities([a.encode(), b.encode()])
    assert np.allclose(both, parts.mean(axis=0), atol=1e-5)


def test_no_letters(spark, model):
    rows = [(1, None), (2, ""), (3, "123 --- !?"), (4, "the and of in to that with"), (None, "the and of"), (4, "the and of in to that with")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'zz' as lang_pred", "9 as id", "1 as score")
    got = sorted(map(tuple, language.languages(df, model).select("id", "lang_pred").collect()), key=repr)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en")], key=repr)
    assert language.languages(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc def", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = language.op4_language_id(df).collect()
    assert {r.lang_pred for r in got} <= {"und", "en"} and all(0 <= r.score <= 1 for r in got)
    one = spark.createDataFrame([(i, "abc def ghi", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.op4_language_id(one).collect()} == {"xx"}
