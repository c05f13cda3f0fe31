"""Language of whole texts by a bidirectional gated recurrent network over their UTF-8 bytes.

One network reads each segment of `SPAN` bytes from the left, one from the right; at every byte a softmax over both
states gives the probabilities of the languages, and a text's probabilities are the mean over all its bytes. Segments
follow each other without gap over the whole text, so a long text is read by many rows of one matrix product instead
of one long chain. The network is trained in numpy by backpropagation through time, every position carrying its text's
label, on windows spread evenly over a bounded sample of texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import map_texts, remainder, sample_order

SPAN = 128  # bytes of a segment
WINDOW = 64  # bytes of a training window
BLOCK = 2048  # segments computed at a time
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Cell:
    """A gated recurrent unit of h states over bytes; its gates are reset, update and candidate."""

    inputs: np.ndarray  # 256 x 3h, biases included
    states: np.ndarray  # h x 3h


@dataclass
class Model:
    languages: list[str]
    left: Cell
    right: Cell
    out: np.ndarray  # 2h x languages
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability."""
        marked = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if marked and self.languages:
            chances = self.probabilities([texts[i].encode("utf-8", "surrogatepass") for i in marked])
            best = chances.argmax(axis=1)
            for i, k, p in zip(marked, best.tolist(), chances.max(axis=1).tolist()):
                names[i], scores[i] = self.languages[k], min(1.0, max(0.0, p))
        return names, scores

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all bytes of the probabilities at each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + bytes(SPAN), np.uint8)
        parts = -(-sizes // SPAN)
        text = np.repeat(np.arange(len(texts)), parts)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(sizes) - sizes)[text] + k * SPAN
        length = np.minimum(SPAN, sizes[text] - k * SPAN)
        order = np.argsort(-length, kind="stable")  # then the rows in use at each step are the first ones
        sums = np.zeros((len(text), len(self.languages)))
        for a in range(0, len(order), BLOCK):
            rows = order[a : a + BLOCK]
            sums[rows] = self._positions(data[begin[rows, None] + np.arange(SPAN)].T, length[rows])
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, text, sums)
        return total / np.maximum(1, sizes)[:, None]

    def _positions(self, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each segment (a column of `codes`) of the probabilities at each."""
        h, rows = len(self.left.states), codes.shape[1]
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(1, steps + 1), "right").tolist()
        left, right = turned(self.left), turned(self.right)
        kept = np.zeros((steps, h, rows), np.float32)
        state = np.zeros((h, rows), np.float32)
        for t in range(steps):
            n = active[t]
            step(left, codes[t, :n], state[:, :n])
            kept[t] = state
        state[:] = 0
        sums = np.zeros((len(self.languages), rows), np.float32)
        upper, lower = (np.ascontiguousarray(x.T, np.float32) for x in (self.out[:h], self.out[h:]))
        bias = self.bias.astype(np.float32)[:, None]
        for t in reversed(range(steps)):
            n = active[t]
            step(right, codes[t, :n], state[:, :n])
            chance = upper @ kept[t, :, :n]
            chance += lower @ state[:, :n]
            chance += bias
            np.minimum(chance, 60, out=chance)
            np.exp(chance, out=chance)
            chance /= chance.sum(axis=0) + np.float32(1e-30)
            sums[:, :n] += chance
        return sums.T


def turned(cell: Cell) -> tuple[np.ndarray, np.ndarray]:
    """The cell for `step`: gates in rows, and halved where the gate is (1 + tanh(x / 2)) / 2."""
    h = len(cell.states)
    gates, ones = np.full(2 * h, 0.5), np.ones(h)
    return (
        np.ascontiguousarray((cell.inputs * np.concatenate([gates, ones])).T, np.float32),
        np.ascontiguousarray((cell.states * 0.5).T, np.float32),
    )


def step(cell: tuple[np.ndarray, np.ndarray], codes: np.ndarray, state: np.ndarray) -> None:
    """One byte further, in place: a column of `state` for each byte of `codes`."""
    inputs, states = cell
    h = len(state)
    given = inputs.take(codes, axis=1, mode="clip")
    held = states @ state
    gates = given[: 2 * h]
    gates += held[: 2 * h]
    np.tanh(gates, out=gates)
    new, half = given[2 * h :], held[2 * h :]  # reset * held is half + gate * half
    new += half
    half *= gates[:h]
    new += half
    np.tanh(new, out=new)
    state -= new
    state *= np.float32(0.5)
    gates[h:] *= state  # update * (state - new)
    state += gates[h:]
    state += new


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(cell: Cell, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each byte (steps x rows x h) and what backpropagation needs."""
    h, (steps, rows) = len(cell.states), codes.shape
    states = np.zeros((steps + 1, rows, h))
    tape = []
    for t in range(steps):
        given, held = cell.inputs[codes[t]], states[t] @ cell.states
        gates = _sigmoid(given[:, : 2 * h] + held[:, : 2 * h])
        reset, update = gates[:, :h], gates[:, h:]
        new = np.tanh(given[:, 2 * h :] + reset * held[:, 2 * h :])
        states[t + 1] = (1 - update) * new + update * states[t]
        tape.append((reset, update, new, held[:, 2 * h :]))
    return states, tape


def _back(cell: Cell, codes: np.ndarray, states: np.ndarray, tape: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of inputs and states, from those of the states after each byte."""
    h, steps = len(cell.states), len(codes)
    given = np.zeros((*codes.shape, 3 * h))
    d_states = np.zeros_like(cell.states)
    flow = np.zeros(states.shape[1:])
    for t in reversed(range(steps)):
        reset, update, new, held = tape[t]
        flow = flow + grad[t]
        d_new = flow * (1 - update) * (1 - new * new)
        d_update = flow * (states[t] - new) * update * (1 - update)
        d_reset = d_new * held * reset * (1 - reset)
        given[t] = np.concatenate([d_reset, d_update, d_new], axis=1)
        d_held = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
        d_states += states[t].T @ d_held
        flow = flow * update + d_held @ cell.states.T
    flat, d_inputs = codes.ravel(), np.zeros_like(cell.inputs)
    np.add.at(d_inputs, flat, given.reshape(-1, 3 * h))
    return [d_inputs, d_states]


def train(windows: list[bytes], labels: list[str], h: int = 8, rounds: int = 220, batch: int = 128, seed: int = 11) -> Model:
    """Backpropagation through time with Adam on windows of `WINDOW` bytes; windows of shorter texts wrap around."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)

    def cell() -> Cell:
        return Cell(rng.normal(0, 0.3, (256, 3 * h)), rng.normal(0, h**-0.5, (h, 3 * h)))

    model = Model(languages, cell(), cell(), rng.normal(0, 0.3, (2 * h, k)), np.zeros(k))
    windows, labels = zip(*((w, l) for w, l in zip(windows, labels) if w)) if any(windows) else ((), ())
    if k < 2 or not windows:
        return model
    data = np.array([np.resize(np.frombuffer(w, np.uint8), WINDOW) for w in windows])
    truth = np.array([languages.index(l) for l in labels])
    # languages in equal parts
    weight = (1 / np.bincount(truth, minlength=k))[truth]
    weight /= weight.sum()
    params = [model.left.inputs, model.left.states, model.right.inputs, model.right.states, model.out, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        rows = rng.choice(len(data), batch, p=weight)
        codes, y = data[rows].T, np.eye(k)[truth[rows]]
        forth, tape_l = _run(model.left, codes)
        back, tape_r = _run(model.right, codes[::-1])
        both = np.concatenate([forth[1:], back[1:][::-1]], axis=2)
        logits = both @ model.out + model.bias
        chance = np.exp(logits - logits.max(axis=2, keepdims=True))
        chance /= chance.sum(axis=2, keepdims=True)
        error = (chance - y) / (WINDOW * batch)
        d_both = error @ model.out.T
        grads = [
            *_back(model.left, codes, forth, tape_l, d_both[:, :, :h]),
            *_back(model.right, codes[::-1], back, tape_r, d_both[::-1, :, h:]),
            np.tensordot(both, error, axes=([0, 1], [0, 1])),
            error.sum(axis=(0, 1)),
        ]
        rate = 0.02 * (1 - turn / (rounds + 1))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return model


def fit(docs: DataFrame, rows: int = 1500, per_text: int = 8, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from windows of at most `rows` training texts, `per_text` of each, spread evenly over the whole text.

    Training rows have a language and an id whose crc32 modulo 3 is not 1. Ids are drawn first, without texts; the
    drawn table has `rows` rows at most and is broadcast.
    """
    known = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("id"), 3) != 1)
    )
    drawn = known.select("id").distinct().orderBy(sample_order(F.col("id")), "id").limit(rows)
    step = F.greatest(F.length("text") - WINDOW, F.lit(0)) / F.lit(max(1, per_text - 1))
    windows = F.transform(
        F.sequence(F.lit(0), F.lit(per_text - 1)),
        lambda k: F.substring(F.col("text"), (F.floor(k * step) + 1).cast("int"), F.lit(WINDOW)),
    )
    taken = (
        known.filter(F.length("text") > 0)
        .join(F.broadcast(drawn), "id", "left_semi")
        .select("id", F.struct("lang", windows.alias("windows")).alias("one"))
        .groupBy("id")  # an id may have several rows: the least one counts
        .agg(F.min("one").alias("one"))
    )
    got = sorted(((r["id"], k, w, r["one"]["lang"]) for r in taken.collect() for k, w in enumerate(r["one"]["windows"])), key=repr)
    return train([w.encode("utf-8", "surrogatepass")[:WINDOW] for _, _, w, _ in got], [g[3] for g in got])


def languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of `docs`: the likeliest language and its mean probability.

    Texts that are NULL or hold no letter are `und` with score 0, as is every text if no language was learned. Rows
    without id and repeated rows are labelled like others; other columns are not read. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, [F.col(key).alias("id")], "lang_pred string, score double", lambda: shared.value.predict)


def op4_language_id(docs: DataFrame) -> DataFrame:
    return languages(docs, fit(docs)).select(
        F.col("id").alias("doc_id"), (F.coalesce(remainder(F.col("id"), 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score"
    )
