"""Near-duplicate documents by 64-bit SimHash, found through a byte-position inverted index.

A fingerprint is eight bytes at eight positions. Two fingerprints that differ in at most `bits` bits (3 at
most) differ in at most 3 bytes, so they share at least 5 (position, byte) postings: the guaranteed minimum.
Postings of single bytes hold 1/256 of all fingerprints each, too many to pair. So the index lists each
fingerprint under conjunctions of three single-byte postings, all triples of positions 0-3 and all of 4-7:
of any five shared positions three lie in one half, so every pair that reaches the minimum meets in some
list. A pair is taken from the first list it meets in, its shared positional bytes are tallied, pairs
below the minimum go, and the rest are verified by counting differing bits. No pair is lost.

Equal fingerprints are folded to one before anything is paired, so copies never meet as pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import components, every, stored

SEED = 42
BLOCK = 1 << 15  # shingles hashed at a time, which bounds memory on very long texts
TRIPLES = [t for half in (range(4), range(4, 8)) for t in itertools.combinations(half, 3)]


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        digests = b"".join(
            xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])
        )
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp) for every row; NULL and blank texts have fingerprint 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select(F.col(key).alias("id"), simhash(F.col(text)).alias("fp"))


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(255 << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _shared_bytes(x: Column) -> Column:
    """Positions at which two fingerprints hold the same byte; x is their exclusive or."""
    return sum(F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8))


def similar_fingerprints(classes: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs (a, b) of representatives whose fingerprints differ in 1 to `bits` bits.

    `classes` has one row per distinct fingerprint: (fp, rep). `bits` is 0 to 3, for which the index is exact.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees a shared list for at most 3 differing bits")
    lists = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("bytes"))
            for k, t in enumerate(TRIPLES)
        )
    )
    postings = classes.select("fp", "rep", F.explode(lists).alias("l")).select("fp", "rep", "l.k", "l.bytes")
    a, b = postings.alias("a"), postings.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*(F.when(x.bitwiseAND(F.lit(_mask(t))) == 0, k) for k, t in enumerate(TRIPLES)))
    return a.join(
        b,
        (F.col("a.k") == F.col("b.k"))
        & (F.col("a.bytes") == F.col("b.bytes"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (first == F.col("a.k"))
        & (_shared_bytes(x) >= 8 - bits)
        & (F.bit_count(x) <= bits),
    ).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3
) -> DataFrame:
    """(id, fp, component) for every row of `docs`: component is the smallest id reachable by links.

    Rows with equal fingerprints are linked, also the empty ones at fingerprint 0. Repeated rows and
    repeated ids each keep their row. A row without id has its fingerprint, links nothing and has a
    NULL component. Other columns are not read. An empty table gives an empty one.
    """
    marked = stored(fingerprints(docs, key, text, width), "simhash")
    classes = stored(marked.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    roots = components(similar_fingerprints(classes, bits), "simhash-links")
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("root", "rep").alias("component")
    )
    return marked.join(named, F.col("fp") == F.col("class_fp"), "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """The rows of `docs` that stand for their group: of each component the row with the smallest id, once.

    Of rows that share that id one with the least text stays. Rows without id are in no group; all of them stay. What
    goes is found on ids alone: texts are read once more and meet only the ids that go.
    """
    groups = near_duplicates(docs, key, text, width, bits).filter("id is not null")
    ids = groups.groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("stands"), F.count("*").alias("n"))
    gone = stored(ids.filter("not stands or n > 1"), "simhash-gone").withColumnRenamed("id", "gone_id")
    kept = docs.join(gone.select("gone_id"), docs[key] == F.col("gone_id"), "left_anti")
    again = gone.filter("stands and n > 1").select("gone_id")
    if again.isEmpty():
        return kept
    rows = docs.join(again, docs[key] == F.col("gone_id"), "left_semi").select(F.struct(*every(docs)).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    one = rows.groupBy("id").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return kept.union(one.select("row.*"))


def op7_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
