"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Every run of exponent two or more holds a root that is a Lyndon word, the longest one that begins where it does, under
the order of words or under the reverse order. So Lyndon arrays under both orders name every root there can be. They come
from grouping alone, the first phase of Baier's suffix sorter: suffixes begin in groups by their first word; from the
highest group down, each suffix of a group extends the nearest suffix to its left of a lower group, whose group is split
by how many extend it. In the end a suffix's group has its longest Lyndon prefix as context, and two suffixes share a
group when these prefixes are the same words. No suffix array is built.

Equal roots side by side are one chain of a group. Each chain is extended to the left and to the right by the longest
common extension with itself one period on, compared in blocks of doubling size.

For runs of exponent four and more, and six words and more, texts are first cut to the places that can hold any: each
three words in a row within such a run come three times at least in it, so also in the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import map_texts

MIX = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def grouped(ranks: Sequence[int]) -> tuple[list[int], list[int]]:
    """(length of the longest Lyndon word that begins at each place, its group) by grouping suffixes.

    `ranks` are numbers from 0 whose order is that of the words. What follows the end is lower than any word.
    """
    n = len(ranks)
    groups = max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(groups)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, size = list(ranks), [1] * groups
    below, above = list(range(-1, groups - 1)), list(range(1, groups + 1))  # neighbours in the order of groups
    above[-1:] = [-1]
    length = [0] * n
    left = list(range(n + 1))  # left[i + 1] leads to the nearest place up to i whose group is lower, as place + 1
    now = groups - 1
    while now >= 0:
        live = [i for i in members[now] if group[i] == now]
        width = size[now]
        for i in live:
            length[i] = width
            left[i + 1] = i
        times: dict[int, int] = {}
        for i in live:
            at = i
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            if at:
                times[at - 1] = times.get(at - 1, 0) + 1
        members[now] = []
        if times:
            split: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                split.setdefault((k, group[j]), []).append(j)
            # those extended most often go highest
            for (k, old), some in sorted(split.items(), key=lambda x: -x[0][0]) if len(split) > 1 else split.items():
                new = len(members)
                members.append(some)
                size.append(size[old] + k * width)
                over = above[old]
                below.append(old)
                above.append(over)
                above[old] = new
                if over >= 0:
                    below[over] = new
                for j in some:
                    group[j] = new
        now = below[now]
    return length, group


def extension(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on, for i < j."""
    at, step, most = 0, 16, len(words) - j
    while at < most:
        step = min(step, most - at)
        same = words[i + at : i + at + step] == words[j + at : j + at + step]
        if not same.all():
            return at + int(same.argmin())
        at += step
        step *= 2
    return most


def runs(words: Sequence[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of `least` periods or more, by start and period; `least` is 2 at least."""
    n = len(words)
    found: set[tuple[int, int, int]] = set()
    if n < 2:
        return []
    array = np.asarray(words, np.int64)
    _, ranks = np.unique(array, return_inverse=True)
    there, back = ranks, ranks[::-1]
    for order in (ranks, ranks.max() - ranks):
        length, group = map(np.asarray, grouped(order.tolist()))
        at = np.arange(n)
        before, after = at - length, at + length
        # a run of `least` periods has one root fewer in a row, wherever the first one begins
        head = (before < 0) | (group[before] != group)
        # a root may come again at the front of a chain: its place one period earlier then has another group
        chain = head.copy()
        for k in range(1, least - 1):
            next_ = np.minimum(at + k * length, n - 1)
            chain &= (at + k * length < n) & (group[next_] == group)
        for i in np.flatnonzero(chain & (after < n)).tolist():
            p = int(length[i])
            right = extension(there, i, i + p)
            if right + p + p - 1 < least * p:  # what lies to the left is shorter than a period
                continue
            start = i - extension(back, n - i - p, n - i)
            if i + p + right - start >= least * p:
                found.add((start, i + p + right - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def possible(words: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches that can hold runs of exponent 4 and 6 words or more."""
    n = len(words)
    if n < 6:
        return []
    code = words.astype(np.uint64)
    code = (code[:-2] * MIX + code[1:-1]) * MIX + code[2:]  # two codes may fall together, which only keeps more
    order = np.argsort(code, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    times = np.diff(np.append(begins, len(code)))
    often = order[np.repeat(times >= 3, times)]
    alive = np.zeros(n, bool)
    for k in range(3):
        alive[often + k] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.astype(np.int8), [0]])))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= 6]


def long_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of 4 periods and 6 words or more, by start and period."""
    found = []
    for a, b in possible(words):
        found += [(a + start, n, p) for start, n, p in runs(words[a:b].tolist(), 4) if n >= 6]
    return found


def planted(words: np.ndarray, key: int | None) -> np.ndarray:
    """The words of one document in ten with all from some place on replaced by repetitions of the words from there."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], np.resize(words[a : a + p], n - a)])


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if of every run only the first period stays."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone)[:n] == 0


def described(text: str | None, key: int | None = None, plant: bool = False) -> tuple:
    """The values of `FIELDS` of one text."""
    spelled = (text or "").encode("utf-8", "surrogatepass").split()
    numbers: dict[bytes, int] = {}
    given = np.fromiter((numbers.setdefault(w, len(numbers)) for w in spelled), np.int64, len(spelled))
    words = planted(given, key) if plant else given
    found = long_runs(words)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    names = list(numbers)
    if found or words is not given:
        spelled = map(names.__getitem__, words[collapsed(len(words), found)].tolist())
    short = b" ".join(spelled)
    best = (None,) * 4
    for s, n, p in found:  # by start and period, so the first of equals stays
        if best[0] is None or n * best[2] > best[1] * p:
            best = (s, n, p, 1000 * n // p)
    return len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(short).hexdigest()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: Column | None = None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row of `docs`.

    Words lie between ASCII white space; runs have a smallest period q and max(6, 4q) words or more. Start to exponent are
    those of the run of greatest exponent, NULL where there is none. NULL, empty and blank texts have no word. `plant` is
    the number whose crc32 chooses texts to be made periodic first; NULL numbers choose nothing. Rows without id and
    repeated rows are read like others; other columns are not read. An empty table gives an empty one. Texts are read
    whole and where they lie, nothing is shuffled; memory of a task follows the words of one text.
    """
    carry = [F.col(key).alias("id")]
    if plant is None:
        return map_texts(docs, text, carry, FIELDS, lambda: lambda texts: list(zip(*map(described, texts))))
    # the number rides in front of the text
    docs = docs.select(*carry, F.concat(F.coalesce(plant.cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("numbered"))

    def make():
        def one(numbered):
            number, _, rest = numbered.partition(" ")
            return described(rest, int(number) if number else None, True)

        return lambda texts: list(zip(*map(one, texts)))

    return map_texts(docs, "numbered", [F.col("id")], FIELDS, make)


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    return periodic_runs(docs, plant=F.col("doc_id")).withColumnRenamed("id", "doc_id")
