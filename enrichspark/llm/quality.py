"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is the counts of its hashed terms: byte trigrams, and runs of four character shapes (lower case, upper case,
digit, blank, line break, each mark by itself), over its whole length, and how much of it repeats. Terms are damped
(log), weighted by inverse document frequency and rotated onto the leading singular directions of the labelled texts'
matrix: latent semantic analysis. The labelled vectors, at most `rows` of them, go to the executors; every text is
compared with all of them by exact cosine products in blocks, and the labels of its nearest neighbours vote with a
weight that rises with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import every, fresh, labelled_sample, map_texts, remainder

TRIGRAMS, SHAPES, REPEATS = 1024, 512, 32
TERMS = TRIGRAMS + SHAPES + REPEATS
DIRECTIONS = 48
NEIGHBOURS = 31
BLOCK = 1024  # texts compared with the labelled vectors at a time

_SHAPE = np.zeros(256, np.uint32)
for _b in range(128):
    _c = chr(_b)
    _SHAPE[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t" else 4 if _c in "\n\r" else 0 if _c.islower() else 5 + _b


def _hashed(codes: np.ndarray, size: int, n: int) -> np.ndarray:
    out = codes[: n - size + 1].copy()
    for j in range(1, size):
        out *= np.uint32(16777619)
        out ^= codes[j : n - size + 1 + j]
    out *= np.uint32(2654435761)
    out >>= np.uint32(12)
    return out


def repeats(text: str) -> np.ndarray:
    """Shares of repeated words and lines, as counts of terms: a long run of equal words is a trait of its own."""
    out = np.zeros(REPEATS, np.float32)
    words, lines = text.split(), text.split("\n")
    if words:
        half = REPEATS // 2
        out[min(half - 1, int(half * len(set(words)) / len(words)))] = len(words)
        out[half + min(half - 1, int(half * len(set(lines)) / len(lines)))] = len(words)
    return out


def term_counts(texts: list[str | None]) -> np.ndarray:
    """A row of term counts for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = len(data)
        if n >= 4:
            codes = data.astype(np.uint32)
            out[i, :TRIGRAMS] = np.bincount(_hashed(codes, 3, n) % TRIGRAMS, minlength=TRIGRAMS)
            out[i, TRIGRAMS : TRIGRAMS + SHAPES] = np.bincount(_hashed(_SHAPE[data], 4, n) % SHAPES, minlength=SHAPES)
            out[i, TRIGRAMS + SHAPES :] = repeats(text)
    return out


@dataclass
class Model:
    weight: np.ndarray  # inverse document frequency of each term
    rotation: np.ndarray  # terms x directions
    known: np.ndarray  # labelled vectors, of length 1
    labels: np.ndarray
    share: float  # of label 1, the vote where nothing is similar

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weight
        x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
        v = x @ self.rotation
        return v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a in range(0, len(texts), BLOCK):
            out[a : a + BLOCK] = self.vote(self.vectors(term_counts(texts[a : a + BLOCK])))
        return out

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(vectors), self.share)
        near = vectors @ self.known.T
        k = min(NEIGHBOURS, near.shape[1])
        # the k-th similarity; all at or above it vote, so ties do not hang on the order of labelled rows
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        power = np.where(near >= np.maximum(least, 1e-9), near, 0) ** 8
        total = power.sum(axis=1)
        return np.clip(np.where(total > 0, power @ self.labels / np.maximum(total, 1e-300), self.share), 0, 1)


def train(counts: np.ndarray, labels: np.ndarray) -> Model:
    labels = np.asarray(labels, np.float64)
    n = len(labels)
    if not n:
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), labels, 0.5)
    weight = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 0.1
    x = np.log1p(counts) * weight
    x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    _, vectors = np.linalg.eigh(x.T @ x)
    model = Model(weight, np.ascontiguousarray(vectors[:, ::-1][:, :DIRECTIONS]), np.zeros((0, 1)), labels, float(labels.mean()))
    model.known = model.vectors(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000, key: str = "doc_id", text: str = "text") -> Model:
    """A model from at most `rows` labelled training texts; their term counts are made on the executors."""
    sample = labelled_sample(docs, labels, label, rows, key, text)

    def packed():
        return lambda texts: [[row.tobytes() for row in term_counts(texts).astype(np.float16)]]

    got = map_texts(sample, "text", [F.col("id"), F.col("label")], "terms binary", packed).collect()
    got = sorted(((r["id"], r["label"], bytes(r["terms"])) for r in got), key=repr)
    counts = np.frombuffer(b"".join(t for _, _, t in got), np.float16).reshape(-1, TERMS).astype(np.float64)
    return train(np.minimum(counts, 60000), np.array([y for _, y, _ in got]))


def quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): how likely label 1 is, for every row of `docs`.

    NULL, empty and tiny texts have no term and score the share of label 1 among the labelled texts, as does any text
    if nothing is labelled (0.5 then). Rows without id and repeated rows are scored like others; other columns are not
    read. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, [F.col(key).alias("id")], "score double", lambda: lambda texts: [shared.value.score(texts)])


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score at least the threshold, with their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text))
    name = fresh(docs, "quality_score")
    scored = map_texts(
        docs, text, every(docs), f"`{name}` double", lambda: lambda texts: [shared.value.score(texts)]
    )
    return scored.filter(F.col(name) >= threshold).select(*every(docs))


def op6_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"),
        (F.coalesce(remainder(F.col("id"), 5), F.lit(1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
