"""Packing documents into training sequences of several permitted lengths, by best fit.

Each document is a run of tokens; runs longer than the longest sequence are cut into whole sequences and a rest.
Pieces are dealt by a hash into packs of about `pack_rows` rows, whose number follows the data (rows that share an id, or
have none, by their stored number), and each pack is packed on its own: long pieces first, each into the open bin it leaves least room in. Where none has room, the bin size opened
is the one of least cost for each token it can still be filled with, given what is left of the pack. At the end each
bin shrinks to the cheapest permitted length that holds its contents. No pack grows with the data, and a hot source or
a flood of equal documents is spread like any other.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import stored

PACKED = "id {}, piece long, start long, length long, bin_id long, capacity long, bin_offset long"


def best_fit(lengths: Sequence[int], sizes: Sequence[int], costs: Sequence[float]) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of every piece; pieces come longest first and none is longer than the largest size."""
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    filled: list[int] = []
    placed = []
    for n in lengths:
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, k = room.pop(at)
        else:
            size = min(
                (c / min(s, max(left, 1)), s) for s, c in zip(sizes, costs) if s >= n
            )[1]
            free, k = size, len(filled)
            filled.append(0)
        placed.append((k, filled[k]))
        filled[k] += n
        left -= n
        bisect.insort(room, (free - n, k))
    final = [min((c, s) for s, c in zip(sizes, costs) if s >= held)[1] for held in filled]
    return [(k, final[k], offset) for k, offset in placed]


def pieces(docs: DataFrame, key: str, length: Column, longest: int) -> DataFrame:
    """(id, piece, start, length): runs of at most `longest` tokens; an empty document is one piece of length 0."""
    n = F.coalesce(length, F.lit(0)).cast("long")
    return (
        docs.select(F.col(key).alias("id"), n.alias("n"))
        .select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / longest).cast("long") - 1))).alias("piece"))
        .select("id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"))
    )


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    length: Column | None = None,
    sizes: Sequence[int] = (2048, 4096, 8192),
    costs: Sequence[float] | None = None,
    pack_rows: int = 4096,
) -> DataFrame:
    """Where every token of every document goes: (id, piece, start, length, bin_id, capacity, bin_offset).

    `length` is the tokens of a row, UTF-8 bytes of `text` by default; NULL and empty texts have none and give one piece
    of length 0, which takes no room. `costs` has the price of a sequence of each size, by default its length plus 64
    for what any sequence costs. Rows without id and repeated rows are packed like others. An empty table gives an
    empty one. Bins of different packs never share a bin_id.
    """
    sizes = sorted(sizes)
    costs = [s + 64 for s in sizes] if costs is None else list(costs)
    length = F.octet_length(F.col("text")) if length is None else length
    cut = stored(pieces(docs, key, length, sizes[-1]).withColumn("row", F.monotonically_increasing_id()), "pieces")
    packs = 1 + cut.count() // pack_rows
    # rows of one id must not share a pack because they share a hash
    again = stored(cut.filter("piece = 0").groupBy("id").count().filter("count > 1"), "pieces-again").select(F.col("id").alias("again"))
    salt = F.lit(0).cast("long")
    if not again.isEmpty():
        cut = cut.join(again, F.col("id").eqNullSafe(F.col("again")), "left")
        several = F.col("id").isNull() | F.col("again").isNotNull()
        salt = F.when(several, F.col("row")).otherwise(salt)
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("id", "piece", salt), F.lit(packs)))
    dealt = dealt.select("id", "piece", "start", "length", "pack")
    kind = cut.schema["id"].dataType.simpleString()

    def place(group, table):
        import pyarrow as pa

        order = [("length", "descending"), ("id", "ascending"), ("piece", "ascending")]
        table = table.sort_by(order)
        placed = best_fit(table["length"].to_pylist(), sizes, costs)
        base = group[0].as_py() << 32
        bins, capacities, offsets = zip(*placed)
        return pa.table(
            {
                **{c: table[c] for c in ("id", "piece", "start", "length")},
                "bin_id": pa.array([base + b for b in bins], pa.int64()),
                "capacity": pa.array(capacities, pa.int64()),
                "bin_offset": pa.array(offsets, pa.int64()),
            }
        )

    return dealt.groupBy("pack").applyInArrow(place, PACKED.format(kind))


def bins(packed: DataFrame) -> DataFrame:
    """(bin_id, capacity, tokens, pieces): one row per sequence."""
    return packed.groupBy("bin_id").agg(
        F.max("capacity").alias("capacity"), F.sum("length").alias("tokens"), F.count("*").alias("pieces")
    )


def op3_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).withColumnRenamed("id", "doc_id")
