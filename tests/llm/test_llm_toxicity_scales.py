"""Texts that are toxic by how often mild words come."""

import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from enrichspark.llm import toxicity as tox
from test_llm_toxicity import plain_score

HELD_OUT = "/root/testdata/sf0.1"

FILLER = "the of and to in that with for on was by it this as be are from or".split()
ENDS = "en er ung keit bar sam los haft".split()


def texts(seed, n):
    rng = np.random.default_rng(seed)
    out, labels = [], []
    for i in range(n):
        words = rng.choice(FILLER, rng.integers(150, 1200))
        bad = i % 6 == 0
        # every clean text has a mild word or two as well
        for at in rng.choice(len(words), max(2, len(words) // 40) if bad else rng.integers(1, 3), replace=False):
            words[at] = "achlich" + rng.choice(ENDS)
        out.append(" ".join(words))
        labels.append(int(bad))
    return out, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return tox.train_scales(*texts(1, 600))


def test_mild_words_by_rate(model):
    given, y = texts(2, 300)
    found = model.score(given) >= 0.5
    assert found[y == 1].mean() > 0.9 and found[y == 0].mean() < 0.05
    assert ((model.models[0].score(given) >= 0.5) & (y == 1)).sum() < found[y == 1].sum()  # a window alone misses them


def plain(text, model):
    """No scale says so: the product of what they leave."""
    return 1 - np.prod([1 - plain_score(text, m) for m in model.models])


def test_any_scale_counts(model):
    given = [*texts(3, 8)[0], "", None, "achlichen", "é"]
    assert len(model.models) > 1 and len({m.window for m in model.models}) == len(model.models)
    assert np.allclose(model.score(given), [plain(t, model) for t in given], atol=1e-9)


def loss_of(model, given, y):
    score = np.clip(model.score(given), 1e-12, 1 - 1e-12)
    return -np.mean(np.where(y > 0, np.log(score), np.log(1 - score)))


def test_joint_steps_lower_the_loss_of_the_score():
    given, y = texts(4, 250)
    start = tox.start_scales(given, y.tolist())
    first = tox.train_jointly(given, y.tolist(), start, rounds=0)
    last = tox.train_jointly(given, y.tolist(), start, rounds=20)
    assert np.allclose([first.score(given)], [start.score(given)], atol=0.05)  # but for the small random dimensions
    assert loss_of(last, given, y) < loss_of(first, given, y)
    # every scale's table moved, n-grams beyond the start's own too
    for a, b, c in zip(first.models, last.models, start.models):
        moved = np.flatnonzero(a.table != b.table)
        assert len(moved) > np.count_nonzero(c.table) / 2 and a.bias != b.bias


def test_gradient_is_that_of_the_loss():
    """A step along the slopes changes the loss as the slopes say."""
    rng = np.random.default_rng(2)
    given, y = texts(5, 60)
    table = rng.normal(0, 0.5, 1 << 12)
    start = tox.Scales([tox.Model(table, -0.3), tox.Model(table, -0.5, 32, 1.5), tox.Model(table * 0.5, -0.2, tox.WHOLE)])
    spelled = tox.Spelled(given, len(table), 1)
    step = 1e-6

    def at(per_gram):
        moved = np.zeros(len(table))
        moved[spelled.used] = per_gram
        return loss_of(tox.Scales([tox.Model(m.table + moved, m.bias, m.window, m.gain) for m in start.models]), given, y)

    chance = np.array([m.chance(m.means(given)) for m in start.models])
    toxic = 1 - np.prod(1 - chance, axis=0)
    error = chance * np.where(y > 0, -(1 - toxic) / toxic, 1) / len(y)
    slope = np.zeros(len(spelled.used))
    for m, e in zip(start.models, error):
        _, first, last = tox.worst_windows(m.gain * spelled.words(m.table[spelled.used]), spelled.counts, m.window)
        per_word = np.zeros(len(spelled.spelling))
        for f, l, x in zip(first, last, e):
            per_word[f:l] += m.gain * x / max(1, l - f)
        slope += spelled.back(per_word)
    for _ in range(5):
        way = rng.normal(size=len(slope))
        assert np.isclose((at(step * way) - at(-step * way)) / (2 * step), slope @ way, rtol=1e-3, atol=1e-7)


def test_query_equals_plain_scores(spark):
    """The whole query beside the definition, its model fitted on the same rows."""
    given, y = texts(6, 120)
    rows = [(i, t) for i, t in enumerate(given)] + [(500, None), (501, ""), (502, "achlich"), (None, given[0]), (3, given[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    got = sorted(((r.doc_id, r.held_out, round(r.score, 7), r.predicted) for r in tox.op9_toxicity(docs, labels).collect()), key=repr)
    want = []
    for i, t in rows:
        score = plain(t, model)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(score, 7), int(score >= 0.5)))
    assert got == sorted(want, key=repr)


def test_training_texts_are_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tox, "train_scales", lambda texts, labels: seen.append(texts))
    rows = [(i, f"{i} " + "x" * (i % 90)) for i in range(500)] + [(1000 + i, "long " * 100) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    tox.fit(docs, labels, chars=10_000)
    assert 9_000 < sum(map(len, seen[0])) <= 10_000 and max(map(len, seen[0])) <= 100


@pytest.mark.skipif(not os.path.isdir(HELD_OUT), reason="the given rows are not here")
def test_held_out_rows():
    """Toxic texts found and clean ones left alone among rows the models were not fitted on."""
    docs = pq.read_table(f"{HELD_OUT}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    marks = pq.read_table(f"{HELD_OUT}/labels.parquet").to_pydict()
    marks = {i: t for i, t in zip(marks["doc_id"], marks["toxic"]) if t is not None}
    rows = [(i, t or "", marks[i]) for i, t in zip(docs["doc_id"], docs["text"]) if i in marks]
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    known = sorted((r for r, h in zip(rows, held) if not h and len(r[1]) <= 120_000), key=repr)  # as `fit` takes them
    asked = [r for r, h in zip(rows, held) if h]
    model = tox.train_scales([t for _, t, _ in known], [y for _, _, y in known])
    found = np.concatenate([model.score([t for _, t, _ in asked[k : k + 50]]) for k in range(0, len(asked), 50)]) >= 0.5
    y = np.array([y for _, _, y in asked])
    assert (y == 1).sum() == 97 and found[y == 1].sum() >= 81 and found[y == 0].sum() <= 11


def test_shares_are_means_over_words():
    given = ["the of", "", "achlich the the"]
    table = np.random.default_rng(5).normal(size=1 << 10)
    got = np.concatenate([s for _, s in tox.shares(given, len(table))]) @ table
    assert np.allclose(got, tox.Model(table, 0.0, tox.WHOLE).means(given))


def test_nothing_to_learn():
    assert tox.train_scales([], []).score(["x", None]).tolist() == [0.5, 0.5]
    assert tox.train_scales(["a b"] * 3, [0, 0, 0]).score(["a"])[0] < 0.01
