"""Toxicity by averaged subword embeddings under a linear softmax, in the manner of fastText.

A word is the bag of its character n-grams, its boundaries included; its vector is the mean of their embeddings, and a
window's vector is the mean over its words. A linear softmax over that vector gives the window's class. Embeddings and
softmax are trained jointly in numpy. Misspellings never seen share most n-grams with a known word, and so its vector.

A few words among thousands vanish in the mean of a whole text, so a text is read in windows of `WINDOW` words, all of
it, and has the score of its worst window. In training the gradient goes to the same windows (after a warm-up over
plain means of whole texts).

Mild words that make a text toxic only by how often they come do not show in so short a window. So the softmax has a row
for each of three scales over the one embedding table: windows of `WINDOW` words, windows of `PASSAGE` words, and the mean
of the whole text. A text is toxic if it is at any scale: its score is one less the product of what the scales' worst
windows leave. All rows and all embeddings are trained together on the log loss of that score, from a start that is fitted
scale by scale.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.llm.common import chunks, every, fresh, labelled_sample, map_texts, remainder, sample_order, stored

SIZES = (3, 4, 5)
WINDOW = 8
PASSAGE = 128
WHOLE = 1 << 40
SPACE = 32


def normal(texts: list[str | None]) -> str:
    """One text, one run of words between blanks."""
    return "".join(f" {' '.join((t or '').lower().split())} " for t in texts)


@dataclass
class Subwords:
    """n-grams of a run of texts: n-gram bucket, its word; words of each text."""

    bucket: np.ndarray
    word: np.ndarray
    words: int
    counts: np.ndarray  # words in each text


def word_counts(texts: list[str | None]) -> np.ndarray:
    return np.array([len((t or "").split()) for t in texts], np.int64)


def grams(codes: np.ndarray, buckets: int):
    """(bucket, word) of the n-grams of each size. Words lie between blanks; an n-gram may hold the blank at either
    end of its word. Words are numbered in order."""
    blank = codes == SPACE
    n = len(codes)
    # the word of a position: the number of word beginnings up to it
    begins = ~blank
    begins[1:] &= blank[:-1]
    word = np.cumsum(begins) - 1
    step = codes.astype(np.uint32)
    full = step.copy()
    inside = np.ones(n, bool)  # no blank strictly inside
    for size in range(2, max(SIZES) + 1):
        full = full[: n - size + 1] * np.uint32(16777619)
        full ^= step[size - 1 :]
        if size > 2:
            inside = inside[: n - size + 1] & ~blank[size - 2 : n - 1]
        if size in SIZES:
            at = np.flatnonzero(inside[: n - size + 1])
            mixed = full[at] * np.uint32(2654435761)
            yield (mixed >> np.uint32(8)).astype(np.int64) % buckets, word[at + 1]


def word_scores(texts: list[str | None], *tables: np.ndarray) -> list[np.ndarray]:
    """For each table, the mean over each word's n-grams of a number per bucket."""
    codes = np.frombuffer(normal(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = int(np.count_nonzero((codes[1:] != SPACE) & (codes[:-1] == SPACE)))
    total, held = [np.zeros(n) for _ in tables], np.zeros(n)
    if n:
        for bucket, word in grams(codes, len(tables[0])):
            for t, table in zip(total, tables):
                t += np.bincount(word, table[bucket], n)
            held += np.bincount(word, minlength=n)
    return [t / np.maximum(held, 1) for t in total]


def windows(counts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of the windows that cover every word; the last one of a text reaches back, so
    that only texts shorter than a window have a smaller one."""
    n = np.maximum(1, -(-counts // size))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    held = counts[text]
    first = np.maximum(0, np.minimum(k * size, held - size))
    last = np.minimum(first + size, held)
    base = (np.cumsum(counts) - counts)[text]
    return text, base + first, base + last


def window_means(scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(scores)])
    return (run[last] - run[first]) / np.maximum(1, last - first)


@dataclass
class Model:
    """A number per bucket (its embedding through the softmax, class 1 less class 0) and a bias; for one scale."""

    table: np.ndarray
    bias: float
    window: int = WINDOW
    gain: float = 1.0

    def worst(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean of the worst window of each text, from the scores of its words."""
        text, first, last = windows(counts, self.window)
        worst = np.full(len(counts), -np.inf)
        np.maximum.at(worst, text, window_means(words, first, last))
        return worst

    def means(self, texts: list[str | None]) -> np.ndarray:
        return self.worst(word_scores(texts, self.table)[0], word_counts(texts))

    def chance(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.gain * worst + self.bias, -50, 50)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.chance(self.means(texts))


@dataclass
class Scales:
    """Rows of the softmax over one embedding table; a text is toxic if any scale says so."""

    models: list[Model]

    def score(self, texts: list[str | None]) -> np.ndarray:
        counts = word_counts(texts)
        words = word_scores(texts, *(m.table for m in self.models))
        return 1 - np.prod([1 - m.chance(m.worst(w, counts)) for m, w in zip(self.models, words)], axis=0)


class Spelled:
    """A run of texts by their spellings, each spelling by its n-grams.

    n-grams whose spellings are found in fewer than `min_texts` texts are left out: they could only learn single texts by
    heart."""

    def __init__(self, texts: list[str], buckets: int, min_texts: int):
        self.counts = word_counts(texts)
        names: dict[str, int] = {}
        self.spelling = np.empty(int(self.counts.sum()), np.int32)  # of each word
        spread: list[int] = []  # texts that hold a spelling
        at = 0
        for t in texts:
            words = [names.setdefault(w, len(names)) for w in t.lower().split()]
            self.spelling[at : at + len(words)] = words
            at += len(words)
            spread += [0] * (len(names) - len(spread))
            for w in set(words):
                spread[w] += 1
        held, owner, bucket = np.zeros(len(names)), [], []
        flat = np.frombuffer(normal([" ".join(names)]).encode("utf-32-le", "surrogatepass"), np.uint32)
        for b, w in grams(flat, buckets):
            held += np.bincount(w, minlength=len(names))
            owner.append(w.astype(np.int32))
            bucket.append(b.astype(np.int32))
        self.held = np.maximum(1, held)  # n-grams of each spelling
        owner, bucket, spread = np.concatenate(owner), np.concatenate(bucket), np.array(spread, np.float64)
        wide = np.bincount(bucket, spread[owner], buckets)[bucket] >= min(min_texts, len(texts))
        owner, bucket = owner[wide], bucket[wide]
        order = np.argsort(owner, kind="stable")
        self.owner, bucket = owner[order], bucket[order]  # of each n-gram its spelling
        self.used = np.flatnonzero(np.bincount(bucket, minlength=buckets))  # buckets that have an embedding
        place = np.zeros(buckets, np.int32)
        place[self.used] = np.arange(len(self.used))
        self.local = place[bucket]  # of each n-gram the place of its embedding

    def words(self, per_gram: np.ndarray) -> np.ndarray:
        """For each word the mean of a number per embedding over its n-grams."""
        return (np.bincount(self.owner, per_gram[self.local], len(self.held)) / self.held)[self.spelling]

    def back(self, per_word: np.ndarray) -> np.ndarray:
        """The gradient per embedding, from that per word."""
        per_spelling = np.bincount(self.spelling, per_word, len(self.held)) / self.held
        return np.bincount(self.local, per_spelling[self.owner], len(self.used))


def train(
    texts: list[str],
    labels: list[int],
    buckets: int = 1 << 17,
    dim: int = 8,
    warm: int = 10,
    rounds: int = 120,
    patience: int = 25,
    min_texts: int = 8,
    decay: float = 0.05,
    drop: float = 0.8,
    rate_of_change: float = 0.6,
    seed: int = 7,
) -> Model:
    """Joint training of embeddings and softmax by gradient descent with momentum and weight decay, on the log loss of whole texts. One text
    in five only judges: the round with the lowest loss on those is kept. n-grams whose spellings are found in fewer than `min_texts` texts get no embedding: they could only learn single
    texts by heart."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets), float(np.log(rate / (1 - rate))))
    given = Spelled(texts, buckets, min_texts)
    counts, spelling, held, owner, local, used = given.counts, given.spelling, given.held, given.owner, given.local, given.used
    begin = np.searchsorted(owner, np.arange(len(held)))
    text, first, last = windows(counts)
    starts = np.searchsorted(text, np.arange(len(texts)))
    base = np.cumsum(counts) - counts

    embed = rng.normal(0, 0.1, (len(used), dim))
    weight = rng.normal(0, 0.5, dim)  # class 1 less class 0 of a two-class softmax
    bias = np.log(rate / (1 - rate))
    judge = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.ones(len(y), bool)
    lowest, lowest_at, kept = np.inf, 0, (embed @ weight, float(bias))
    momentum, size_now, rate_of = [np.zeros_like(embed), np.zeros(dim), 0.0], [0.0, 0.0, 0.0], rate_of_change
    for k in range(1, warm + rounds + 1):
        word = np.bincount(owner, (embed @ weight)[local], len(held)) / held
        scores = word[spelling]
        if k <= warm:
            a, b = base, base + counts
        else:
            means = window_means(scores, first, last)
            # windows left out by chance: else a text's strongest word keeps its others from being learned
            means[rng.random(len(means)) < np.where(judge[text], 0, drop)] -= 1e6
            top = np.maximum.reduceat(means, starts)
            best = np.full(len(texts), -1)
            hits = np.flatnonzero(means >= top[text])
            best[text[hits[::-1]]] = hits[::-1]  # the first of equals
            a, b = first[best], last[best]
        logits = window_means(scores, a, b) + bias
        chance = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
        if k > warm:
            loss = -np.log(np.maximum(1e-12, np.where(y > 0, chance, 1 - chance)))[judge].mean()
            if loss < lowest:
                lowest, lowest_at, kept = loss, k, (embed @ weight, float(bias))
            elif k - lowest_at > patience:
                break
        error = np.where(judge & (len(y) >= 50), 0, chance - y) / len(y)
        # each word of a chosen window takes its share of the error, each n-gram its share of the word's
        n = b - a
        share = np.repeat(error / np.maximum(1, n), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        per_word = np.bincount(spelling[at], share, len(held)) / held
        touched = np.flatnonzero(per_word)
        ends = np.append(begin[1:], len(owner))
        size = ends[touched] - begin[touched]
        pick = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[touched], size)
        per_gram = np.bincount(local[pick], np.repeat(per_word[touched], size), len(used))
        # momentum, scaled as a whole: an n-gram moves as far as many texts ask for it, not as far as any other
        steps = (per_gram[:, None] * weight[None, :], embed.T @ per_gram, error.sum())
        momentum = [0.9 * m + 0.1 * g for m, g in zip(momentum, steps)]
        size_now = [max(0.9 * s, float(np.abs(m).max())) for s, m in zip(size_now, momentum)]
        embed -= rate_of * (momentum[0] / (size_now[0] + 1e-12) + decay * embed)
        weight -= 0.1 * rate_of * momentum[1] / (size_now[1] + 1e-12)
        bias -= 0.1 * rate_of * momentum[2] / (size_now[2] + 1e-12)
    table = np.zeros(buckets)
    table[used], bias = kept
    return Model(table, bias)


def shares(texts: list[str], buckets: int):
    """(first text, share of each n-gram bucket in each text) of runs of texts; the shares of a text have sum 1."""
    for a, b in chunks(texts, 1 << 20):
        for k in range(a, b, 32):
            some = texts[k : min(k + 32, b)]
            counts = word_counts(some)
            of = np.repeat(np.arange(len(some)), counts)
            codes = np.frombuffer(normal(some).encode("utf-32-le", "surrogatepass"), np.uint32)
            got = list(grams(codes, buckets)) if len(of) else []
            held = sum(np.bincount(word, minlength=len(of)) for _, word in got)
            out = np.zeros(len(some) * buckets)
            for bucket, word in got:
                out += np.bincount(of[word] * buckets + bucket, 1 / (held[word] * counts[of[word]]), len(out))
            yield k, out.reshape(len(some), buckets)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the least log loss with a ridge on the weights, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    hold = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * hold @ (w * w))

    now = loss(w)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (chance - y) + hold * w
        step = np.linalg.solve((x * (chance * (1 - chance))[:, None]).T @ x + np.diag(hold), slope)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, before = w - step, now
        now = loss(w)
        if before - now < 1e-7 * (1 + now):
            break
    return w[:-1], float(w[-1])


def train_whole(
    texts: list[str], labels: list[int], buckets: int = 1 << 17, kept: int = 256, min_texts: int = 8, ridge: float = 5.0
) -> Model:
    """A softmax over the n-gram shares of whole texts. Of all n-grams those `kept` have weights whose share goes with
    the label most closely."""
    y = np.asarray(labels, np.float64)
    total, square, both, spread = (np.zeros(buckets) for _ in range(4))
    for k, share in shares(texts, buckets):
        total += share.sum(axis=0)
        square += (share * share).sum(axis=0)
        both += y[k : k + len(share)] @ share
        spread += (share > 0).sum(axis=0)
    n = len(y)
    dev = np.sqrt(np.maximum(square / n - (total / n) ** 2, 1e-30))
    goes = np.where(spread >= min(min_texts, n), (both / n - total / n * y.mean()) / dev, 0)
    best = np.sort(np.argsort(-np.abs(goes), kind="stable")[:kept])
    x = np.zeros((n, len(best)))
    for k, share in shares(texts, buckets):
        x[k : k + len(share)] = share[:, best]
    mean, dev = total[best] / n, dev[best]
    weight, bias = logistic((x - mean) / dev, y, ridge)
    table = np.zeros(buckets)
    table[best] = weight / dev
    return Model(table, bias - float(mean @ (weight / dev)), WHOLE)


def worst_windows(scores: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, first word, last word + 1) of the window of highest mean of each text, the first of equals."""
    text, first, last = windows(counts, size)
    means = window_means(scores, first, last)
    top = np.maximum.reduceat(means, np.searchsorted(text, np.arange(len(counts))))
    hits = np.flatnonzero(means >= top[text])[::-1]
    best = np.empty(len(counts), np.int64)
    best[text[hits]] = hits
    return top, first[best], last[best]


def train_jointly(
    texts: list[str], labels: list[int], start: Scales, dim: int = 8, rounds: int = 30, min_texts: int = 8, seed: int = 7
) -> Scales:
    """One embedding table and a softmax row for each scale of `start`, moved together by gradient descent on the log
    loss of the score of whole texts.

    The table begins with what the scales of `start` say of each n-gram, a dimension for each distinct table, and small
    random numbers in the others. A step that does not lower the loss is taken back and halved."""
    rng, y, models = np.random.default_rng(seed), np.asarray(labels, np.float64), start.models
    buckets = len(models[0].table)
    given = Spelled(texts, buckets, min_texts)
    tables = list({id(m.table): m.table for m in models}.values())
    size = [max(1e-9, float(np.abs(t[given.used]).max(initial=0))) for t in tables]
    embed = rng.normal(0, 0.01, (len(given.used), max(dim, len(tables))))
    weight = rng.normal(0, 0.01, (len(models), embed.shape[1]))  # class 1 less class 0 of each scale's softmax
    for d, (t, c) in enumerate(zip(tables, size)):
        embed[:, d] = t[given.used] / c
        for k, m in enumerate(models):
            weight[k, d] = c * m.gain if m.table is t else weight[k, d]
    bias = np.array([m.bias for m in models])
    lowest, kept, slopes, step = np.inf, None, None, 0.01
    for _ in range(rounds + 1):
        found = [worst_windows(given.words(embed @ w), given.counts, m.window) for w, m in zip(weight, models)]
        chance = 1 / (1 + np.exp(-np.clip([z + b for (z, _, _), b in zip(found, bias)], -30, 30)))
        clean = np.log1p(-np.minimum(chance, 1 - 1e-12)).sum(axis=0)  # log chance that no scale says so
        toxic = -np.expm1(clean)
        loss = np.where(y > 0, -np.log(np.maximum(toxic, 1e-12)), -clean).mean()
        if loss < lowest:
            lowest, kept, step = loss, (embed, weight, bias), step * 1.2
            # a toxic text asks most of the scales that are nearest to saying so
            error = chance * np.where(y > 0, -np.exp(clean) / np.maximum(toxic, 1e-9), 1) / len(y)
            per_gram = []
            for (_, first, last), e in zip(found, error):
                share = np.where(last > first, e / np.maximum(1, last - first), 0)
                change = np.bincount(first, share, len(given.spelling) + 1) - np.bincount(last, share, len(given.spelling) + 1)
                per_gram.append(given.back(np.cumsum(change)[:-1]))
            per_gram = np.array(per_gram)
            slopes = per_gram.T @ weight, per_gram @ embed, error.sum(axis=1)
        else:
            step /= 2
        (embed, weight, bias), (d_embed, d_weight, d_bias) = kept, slopes
        most = np.abs(d_weight).max(axis=1, keepdims=True)
        embed = embed - step * d_embed / (np.abs(d_embed).max(initial=0) + 1e-12)
        weight = weight - step * np.abs(weight).max(axis=1, keepdims=True) * d_weight / (most + 1e-12)
        bias = bias - step * d_bias / (np.abs(d_bias).max() + 1e-12)
    embed, weight, bias = kept
    out = []
    for w, b, m in zip(weight, bias, models):
        table = np.zeros(buckets)
        table[given.used] = embed @ w
        out.append(Model(table, float(b), m.window))
    return Scales(out)


def start_scales(texts: list[str], labels: list[int]) -> Scales:
    """A model for each scale, fitted one after the other; the longer scales learn from the clean texts and those toxic
    ones that the ones before miss."""
    y = np.asarray(labels, np.int64)
    short = train(texts, labels)
    models, left = [short], np.ones(len(y), bool)

    def leave():
        for a, b in chunks(texts, 1 << 21):
            left[a:b] &= (models[-1].score(texts[a:b]) < 0.5) | (y[a:b] == 0)
        at = np.flatnonzero(left)
        return [texts[i] for i in at], y[at]

    some, mine = leave() if len(y) else ([], y)
    if mine.sum() < 8 or mine.all():  # nothing a model could be learned from
        return Scales(models)
    whole = train_whole(some, mine.tolist(), len(short.table))
    models.append(whole)
    some, mine = leave()
    if mine.sum() < 8:
        return Scales(models)
    # the same n-grams, read in passages
    worst = np.empty(len(some))
    for a, b in chunks(some, 1 << 21):
        worst[a:b] = Model(whole.table, 0.0, PASSAGE).means(some[a:b])
    gain, bias = logistic(worst[:, None], mine.astype(np.float64), 1e-3)
    if gain[0] > 0:
        models.append(Model(whole.table, bias, PASSAGE, float(gain[0])))
    return Scales(models)


def train_scales(texts: list[str], labels: list[int]) -> Scales:
    """All scales, trained together from where each begins."""
    start = start_scales(texts, labels)
    return train_jointly(texts, labels, start) if len(set(labels)) > 1 and any(word_counts(texts)) else start


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rows: int = 4000,
    chars: int = 12_000_000,
    key: str = "doc_id",
    text: str = "text",
) -> Scales:
    """Models from at most `rows` labelled training texts of at most `chars` characters in all.

    Texts of more than a hundredth of `chars` are not trained on; of the others as many as fit are, in the fixed order of
    the sample. (Texts of any length are scored.)
    """
    sample = labelled_sample(docs, labels, label, rows, key, text).filter(F.length("text") <= chars // 100)
    # `rows` rows at most, so one task may number them
    order = Window.orderBy(sample_order(F.col("id")), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = stored(sample, "toxicity-sample").withColumn("so_far", F.sum(F.length("text")).over(order))
    got = sorted(((r["id"], r["text"], r["label"]) for r in held.filter(F.col("so_far") <= chars).collect()), key=repr)
    return train_scales([t for _, t, _ in got], [y for _, _, y in got])


def toxicity(docs: DataFrame, model: Model | Scales, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the probability that a text is toxic, for every row of `docs`.

    NULL, empty and blank texts have no word and score the model's bias. Rows without id and repeated rows are scored
    like others; other columns are not read. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, [F.col(key).alias("id")], "score double", lambda: lambda texts: [shared.value.score(texts)])


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text))
    name = fresh(docs, "toxicity_score")
    scored = map_texts(
        docs, text, every(docs), f"`{name}` double", lambda: lambda texts: [shared.value.score(texts)]
    )
    return scored.filter(F.col(name) < threshold).select(*every(docs))


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"),
        (F.coalesce(remainder(F.col("id"), 5), F.lit(1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
