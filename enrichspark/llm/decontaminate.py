"""Benchmark passages inside documents, with edits, by the q-gram lemma.

Texts are compared as lower-case words joined by single blanks. A passage of m characters that occurs with
at most k edits shares at least m - q + 1 - k * q of its q-grams with the place it occurs at, and those
q-grams lie on neighbouring diagonals (position in text minus position in passage), k apart at most on
either side. So every shared q-gram is counted, once for each place in the passage, in two overlapping bands of
diagonals, bands with fewer q-grams than the lemma's bound are dropped, and each region left is verified by aligning the passage
within its band. The edit budget k is a share of the passage's length.

The passages form a dictionary that goes to the executors in blocks of a set size; a larger benchmark takes
more passes over the documents, never a larger broadcast. Documents are neither shuffled nor cut.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import chunks, every, fresh, map_texts, stored

BREAK = re.compile(r"[\W_]+")
BATCH_CHARS = 1 << 20  # characters matched at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = 1 << 20  # shared q-grams laid out at a time


def plain(text: str | None) -> str:
    """Lower-case words joined by single blanks."""
    return BREAK.sub(" ", (text or "").lower()).strip()


@functools.cache
def letters(size: int) -> np.ndarray:
    """Which of the first code points belong to words."""
    return np.fromiter((chr(c).isalnum() for c in range(size)), bool, size)


def plain_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the plain texts, each followed by a blank (empty ones are nothing), and where each begins;
    the last entry is the end."""
    low = [(t or "").lower() for t in texts]
    raw = characters("\n".join([*low, ""]))
    word = letters(min(0x110000, 1 << int(raw.max()).bit_length()))[raw]
    kept = word.copy()
    kept[1:] |= word[:-1]  # the first mark after a word stands for all up to the next
    ends = np.cumsum(np.array([len(t) + 1 for t in low], np.int64))
    until = np.concatenate([[0], np.cumsum(kept)])
    return np.where(word, raw, np.uint32(32))[kept], until[np.concatenate([[0], ends])]


def original_span(text: str, start: int, stop: int) -> tuple[int, int]:
    """The range of `text` that characters start to stop of plain(text) come from."""
    low = text.lower()
    at, first, last = 0, 0, len(text)
    for word in re.finditer(r"[^\W_]+", low):
        n = word.end() - word.start()
        if at <= start < at + n + 1:
            first = word.start() + min(start - at, n)
        if at < stop <= at + n + 1:
            last = word.start() + min(stop - at, n)
            break
        at += n + 1
    return min(first, len(text)), min(last, len(text))


def gram_codes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for the q-gram that begins at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].astype(np.uint64)
    for j in range(1, q):
        out *= np.uint64(1000003)
        out += codes[j : j + n]
    out ^= out >> np.uint64(29)
    out *= MIX
    return out


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of the next."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Passages:
    """An index of passages by q-gram, with the lemma's bound for each."""

    def __init__(self, items: list[tuple], q: int, share: float):
        self.q = q
        kept = [(i, plain(t)) for i, t in items]
        kept = [(i, t) for i, t in kept if len(t) >= q]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        # fewer edits on short passages, so that the bound is one q-gram at least
        self.edits = np.maximum(0, np.minimum(np.floor(lengths * share).astype(np.int64), (lengths - q) // q))
        self.least = lengths - q + 1 - self.edits * q
        codes = [gram_codes(characters(t), q) for t in self.texts]
        item = np.repeat(np.arange(len(kept)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes] or [np.zeros(0, np.int64)])
        code = np.concatenate(codes or [np.zeros(0, np.uint64)])
        order = np.argsort(code, kind="stable")
        self.item, self.at = item[order].astype(np.int32), at[order].astype(np.int32)
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        # a passage's band is as wide as the diagonals of one occurrence can spread
        self.width = 2 * int(self.edits.max(initial=0)) + 1
        # diagonals are counted from the first one a text can have with any passage
        self.shift = (int(lengths.max(initial=0)) // self.width + 2) * self.width
        self.bits = 16
        while self.bits < 26 and (1 << self.bits) < 16 * len(self.codes):
            self.bits += 1
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.bits)).astype(np.int64)

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that hold enough shared q-grams. Diagonals run over the whole batch;
        q-grams that reach from one text into the next can only add regions.

        A posting is a place of an item with its q-gram. Places count once for each band, so counts add up over
        postings, however these are split: items are taken in runs that meet `SPREAD` q-grams of the text, and an item
        that meets more by itself in runs of its places. Memory follows the batch and the items, not their product.
        """
        hit = np.flatnonzero(self.seen[self._slot(codes)])
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(hit) or not len(self.codes):
            return nothing
        where = np.searchsorted(self.codes, codes[hit])
        where[where == len(self.codes)] = 0
        same = self.codes[where] == codes[hit]
        hit, where = hit[same], where[same]
        if not len(hit):
            return nothing
        hit = hit[np.argsort(where, kind="stable")]
        met, begin, times = np.unique(np.sort(where), return_index=True, return_counts=True)
        # postings of the q-grams met, by item
        owner = np.repeat(np.arange(len(met)), self.count[met])
        posting = ranges(self.first[met], self.count[met])
        order = np.argsort(self.item[posting], kind="stable")
        owner, posting = owner[order], posting[order]
        item, place, n = self.item[posting].astype(np.int64), self.at[posting].astype(np.int64), times[owner]
        # of an item that meets no more than its bound nothing can come
        total = np.bincount(item, n, len(self.ids))
        live = total[item] >= self.least[item]
        owner, item, place, n = owner[live], item[live], place[live], n[live]
        if not len(item):
            return nothing
        cuts = np.flatnonzero(np.diff(item)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(item))
        sums = np.add.reduceat(n, starts)
        found = [nothing]
        k = 0
        while k < len(starts):
            last = max(k + 1, int(np.searchsorted(np.cumsum(sums[k:]), SPREAD, "right")) + k)
            some = slice(starts[k], ends[last - 1])
            given = (item[some], place[some], n[some], begin[owner[some]], hit)
            found.append(self._bands(*given) if sums[k:last].sum() <= SPREAD else self._heavy(*given, len(codes)))
            k = last
        return tuple(np.concatenate(x) for x in zip(*found))

    def _keys(self, place, n, begin, hit) -> tuple[np.ndarray, np.ndarray]:
        """(band, index of the posting) of each meeting: a diagonal counts in its band and in the one before, as band b
        covers diagonals b * w to (b + 2) * w."""
        of = np.repeat(np.arange(len(place)), n)
        band = (hit[ranges(begin, n)] - place[of] + self.shift) // self.width
        return np.concatenate([band, band - 1]), np.concatenate([of, of])

    def _bands(self, item, place, n, begin, hit) -> tuple[np.ndarray, np.ndarray]:
        band, of = self._keys(place, n, begin, hit)
        bands = int(band.max()) + 1
        key = item[of] * bands + band
        slot = ((key.astype(np.uint64) * MIX) >> np.uint64(44)).astype(np.int64)
        enough = np.bincount(slot, minlength=1 << 20)[slot] >= self.least[item[of]]
        # an occurrence shares q-grams at that many places of the passage: one place met again and again is one
        once = np.unique(of[enough] * bands + band[enough])
        key, counts = np.unique(item[once // bands] * bands + once % bands, return_counts=True)
        key = key[counts >= self.least[key // bands]]
        return key // bands, (key % bands) * self.width - self.shift

    def _heavy(self, item, place, n, begin, hit, length: int) -> tuple[np.ndarray, np.ndarray]:
        """One item that meets more than `SPREAD` q-grams: counts by band are added up over runs of its places."""
        counts = np.zeros((length + self.shift) // self.width + 2, np.int64)
        k, run = 0, np.cumsum(n)
        while k < len(place):
            last = max(k + 1, int(np.searchsorted(run, (run[k - 1] if k else 0) + SPREAD, "right")))
            band, of = self._keys(place[k:last], n[k:last], begin[k:last], hit)
            once = np.unique(of * len(counts) + band)
            counts += np.bincount(once % len(counts), minlength=len(counts))
            k = last
        good = np.flatnonzero(counts >= self.least[item[0]])
        return np.full(len(good), item[0]), good * self.width - self.shift

    def align(self, item: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """The best occurrence of a passage in `text` that starts from low to high and needs no more edits than its
        budget: (edits, start, stop), or None. Only diagonals low - k to high + k are filled."""
        k = int(self.edits[item])
        exact = text.find(self.texts[item], max(low, 0), max(high, 0) + len(self.texts[item]))
        if exact >= 0:
            return 0, exact, exact + len(self.texts[item])
        if not k:
            return None
        passage, codes = characters(self.texts[item]), characters(text)
        m = len(passage)
        first = low - k
        width = high - low + 2 * k + 1
        far = m + k + 1
        diagonals = first + np.arange(width)
        # row i, cell d: best cost of aligning i characters so that the text position is diagonal + i
        starts = (diagonals >= max(low, 0)) & (diagonals <= high) & (diagonals <= len(codes))
        cost = np.where(starts, 0, far)
        start = diagonals.copy()
        steps = np.arange(width)
        for i in range(1, m + 1):
            position = diagonals + i  # text characters used so far
            inside = (position >= 1) & (position <= len(codes))
            same = inside & (codes[np.clip(position - 1, 0, len(codes) - 1)] == passage[i - 1])
            across = np.where(inside, cost + ~same, far)
            skip = np.append(cost[1:], far) + 1  # a character of the passage is missing
            better = skip < across
            new = np.where(better, skip, across)
            begun = np.where(better, np.append(start[1:], 0), start)
            new = np.where((position >= 0) & (position <= len(codes)), new, far)
            # a character of the text is extra: carry the least cost along the row
            run = np.minimum.accumulate(new - steps)
            held = run + steps
            source = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
            start = np.where(held < new, begun[source], begun)
            cost = np.where((position >= 0) & (position <= len(codes)), held, far)
            if cost.min() > k:
                return None
        end = diagonals + m
        best = min(zip(cost.tolist(), (end - start).tolist(), start.tolist(), end.tolist()))
        return (int(best[0]), int(best[2]), int(best[3])) if best[0] <= k else None

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, edits, start, stop) of the best occurrence of each passage in each text, by their numbers."""
        codes, bounds = plain_batch(texts)
        if not len(codes) or not self.ids:
            return
        starts, ends = bounds[:-1], bounds[1:]
        item, low = self.regions(gram_codes(codes, self.q))
        joined: dict[int, str] = {}
        best: dict[tuple[int, int], tuple] = {}
        for i, at in zip(item.tolist(), low.tolist()):
            # a band may touch two texts
            m, k = len(self.texts[i]), int(self.edits[i])
            doc = int(np.searchsorted(ends, max(at, 0), "right"))
            while doc < len(texts) and starts[doc] <= at + 2 * self.width:
                if doc not in joined:
                    joined[doc] = plain(texts[doc])
                from_, to = at - int(starts[doc]) - k, at + 2 * self.width - int(starts[doc]) + k
                base = max(0, from_ - k)
                piece = joined[doc][base : max(0, to + m + 2 * k)]
                got = self.align(i, piece, from_ - base, to - base) if piece else None
                if got:
                    found = (got[0], base + got[1], base + got[2])
                    best[doc, i] = min(best.get((doc, i), found), found)
                doc += 1
        for (doc, i), (edits, start, stop) in sorted(best.items()):
            start, stop = original_span(texts[doc] or "", start, stop)
            yield doc, i, edits, start, stop


_INDEX: dict[str, Passages] = {}  # of the block in use; Python workers serve many tasks


def _index(name: str, items: list[tuple], q: int, share: float) -> Passages:
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Passages(items, q, share)
    return _INDEX[name]


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, q: int, share: float, block_chars: int):
    """The passages in blocks of about `block_chars` characters: for each a function that gives its index in a task."""
    if q * share >= 1:
        raise ValueError("no q-gram need be shared: take a smaller q or fewer edits")
    items = benchmark.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_key).alias("item"), F.col(item_text).alias("words")
    )
    size = items.agg(F.sum(F.length("words")).alias("n")).first()
    blocks = 1 + int(((size and size["n"]) or 0) // block_chars)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).distinct()
        # bounded: a block holds about block_chars characters
        shared = benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["words"]) for r in part.collect()])
        yield functools.partial(lambda name, held: _index(name, held.value, q, share), uuid.uuid4().hex, shared)


def _block_matches(docs: DataFrame, key: str, text: str, item_kind: str, index) -> DataFrame:
    wanted = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], f"id {wanted.schema['id'].dataType.simpleString()}, item {item_kind}, edits int, start long, stop long").schema

    def match(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, passages = to_arrow_schema(out), index()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, BATCH_CHARS):
                rows = list(passages.search(texts[a:b]))
                if rows:
                    doc, item, *rest = zip(*rows)
                    columns = [batch.column(0).take(pa.array([a + d for d in doc])), pa.array([passages.ids[i] for i in item], schema.field(1).type)]
                    columns += [pa.array(x, f.type) for x, f in zip(rest, list(schema)[2:])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return wanted.mapInArrow(match, out)


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    q: int = 8,
    max_edit_share: float = 1 / 12,
    block_chars: int = 16_000_000,
) -> DataFrame:
    """(id, item, edits, start, stop): each passage found in each document, with the fewest edits and the range of
    characters of the document it covers (the first of equals).

    Edits count characters of the plain texts; a passage of m characters may take m * max_edit_share of them, fewer if
    it is shorter than q / (1 - q * max_edit_share), none below 2 * q. Passages with fewer than q plain characters, NULL
    ones included, hold no q-gram and match nothing; nor do empty or NULL texts. Ids of documents and items may be of
    any type; rows without id are left out. Repeated documents and items each give their rows once per distinct result.
    Empty tables give no rows. `block_chars` bounds the characters of passages sent to the executors at once.
    """
    kind = benchmark.schema[item_key].dataType.simpleString()
    found = None
    indexes = list(_blocks(benchmark, item_key, item_text, q, max_edit_share, block_chars))
    for index in indexes:
        got = _block_matches(docs, key, text, kind, index)
        if len(indexes) > 1:
            got = stored(got, "decontaminate")
        found = got if found is None else found.union(got)
    return found.distinct()


def contaminated(matches: DataFrame) -> DataFrame:
    """(id, items, n_items, least_edits): one row per document that holds a passage."""
    return matches.groupBy("id").agg(
        F.array_sort(F.collect_set("item")).alias("items"),
        F.countDistinct("item").alias("n_items"),
        F.min("edits").alias("least_edits"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    q: int = 8,
    max_edit_share: float = 1 / 12,
    block_chars: int = 16_000_000,
) -> DataFrame:
    """The rows of `docs` whose text holds no passage, with their columns as they were.

    Each row is judged by its own text as it passes, whatever its id, so nothing is joined or shuffled; a benchmark of
    several blocks is passed block by block, and each sees only what the one before left. NULL and empty texts stay.
    """
    name = fresh(docs, "holds_passage")

    def judge(index):
        def make():
            def work(texts):
                held = np.zeros(len(texts), bool)
                held[[row[0] for row in index().search(texts)]] = True
                return [held]

            return work

        return make

    kept = docs
    for index in _blocks(benchmark, item_key, item_text, q, max_edit_share, block_chars):
        marked = map_texts(kept, text, every(docs), f"`{name}` boolean", judge(index), BATCH_CHARS)
        kept = marked.filter(~F.col(name)).select(*every(docs))
    return kept


def op10_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = benchmark_matches(docs, benchmark)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        "edits",
        F.col("start").alias("span_start"),
        F.col("stop").alias("span_end"),
    )
