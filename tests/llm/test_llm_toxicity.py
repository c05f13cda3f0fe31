import os

import numpy as np
import pytest

from enrichspark.llm import toxicity as tox

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
FILLER = "the of and to in that with for on was by it this as be are from or".split()


def plain_word_score(word, table):
    """Mean over a word's n-grams, one by one."""
    text, out = f" {word} ", []
    for n in tox.SIZES:
        for i in range(len(text) - n + 1):
            gram = text[i : i + n]
            if " " in gram[1:-1]:
                continue
            h = ord(gram[0])
            for c in gram[1:]:
                h = (h * 16777619 & 0xFFFFFFFF) ^ ord(c)
            out.append(table[((h * 2654435761 & 0xFFFFFFFF) >> 8) % len(table)])
    return float(np.mean(out)) if out else 0.0


def plain_score(text, model):
    words = (text or "").lower().split()
    scores = [plain_word_score(w, model.table) for w in words]
    w = model.window
    if len(words) <= w:
        means = [np.mean(scores) if scores else 0.0]
    else:
        starts = [min(i, len(words) - w) for i in range(0, len(words), w)]
        means = [np.mean(scores[s : s + w]) for s in starts]
    return 1 / (1 + np.exp(-(model.gain * max(means) + model.bias)))


@pytest.fixture(scope="module")
def made():
    """Texts in which a few of twelve words mark the toxic ones, some of them mislabelled."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(700):
        words = rng.choice(FILLER, rng.integers(5, 200)).tolist()
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(words) // 40)):
                words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(["idiot", "stupid", "moron"])))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def model(made):
    return tox.train(*made)


def test_scores_are_those_of_the_definition(made, model):
    texts = made[0][:40] + ["", None, "x", "Idiot!", "é ñandú stupid", "a" * 500]
    assert np.allclose(model.score(texts), [plain_score(t, model) for t in texts], atol=1e-9)


def test_learns_words_and_misspellings(made, model):
    texts, labels = made
    assert np.mean((model.score(texts) >= 0.5) == np.array(labels)) > 0.97
    line = "the of and to {} in that with"
    bad = model.score([line.format(w) for w in ("idiotic", "stupidd", "idiots", "morons", "MORON")])
    good = model.score([line.format(w) for w in ("for", "table", "on")])
    assert bad.min() > good.max()


def test_one_word_in_a_long_text(model):
    words = (FILLER * 400)[:6000]
    clean = " ".join(words)
    words[4321] = "stupid"
    a, b = model.score([clean, " ".join(words)])
    assert a < 0.5 < b


def test_windows_cover_every_word():
    counts = np.array([0, 1, 8, 9, 30])
    text, first, last = tox.windows(counts)
    for t, n in enumerate(counts):
        base = counts[:t].sum()
        seen = {w for k in np.flatnonzero(text == t) for w in range(first[k], last[k])}
        assert seen == set(range(base, base + n))


def test_nothing_to_learn():
    assert tox.train([], []).score(["x", None]).tolist() == [0.5, 0.5]
    assert tox.train(["a b"] * 3, [0, 0, 0]).score(["a"])[0] < 0.01


def test_given_rows(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = tox.op9_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    rows = [(1, None), (2, ""), (None, "stupid idiot"), (3, "the of"), (3, "the of")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxicity_score", "4 as id")
    out = tox.toxicity(df, model).collect()
    assert sorted((r.id for r in out), key=repr) == sorted([1, 2, None, 3, 3], key=repr)
    assert tox.toxicity(df.limit(0), model).count() == 0
    kept = tox.drop_toxic(df, labels.limit(0))
    assert kept.columns == df.columns
