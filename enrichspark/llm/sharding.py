"""Consistent placement of documents on shards through a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own: an offset and a step, both from a hash of
its name, run through all slots. Shards take turns, each claiming the first slot of its order that is still free, until
the table is full. So shards hold equal parts of the table (within one slot), and taking a shard away moves little but
its own slots. A document's slot is a hash of its key modulo the table's size; the table, of a size fixed by parameter,
is broadcast, and placement is one hash lookup.

All of it is DataFrame and SQL functions. The table is filled by folding over probes in one row: the owners of all
slots are a binary value of two bytes a slot, so a claim is a byte overlay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4093  # a prime, over 100 slots for each of 32 shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def hashed(text: Column, first: int = 1) -> Column:
    """48 bits of a text's md5, from its hexadecimal digit number `first`."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 12), 16, 10).cast("bigint")


def preferences(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """(shard, turn, offset, step): who claims when in a round, and the order of slots each shard prefers."""
    names = spark.createDataFrame([(i, s) for i, s in enumerate(shards)], "turn int, shard string")
    return names.select(
        "shard", "turn", (hashed(F.col("shard")) % slots).cast("int").alias("offset"), (hashed(F.col("shard"), 13) % (slots - 1) + 1).cast("int").alias("step")
    )


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table, a row for each slot.

    Shards must be distinct names, at least one and at most as many as slots (and 65,535). The size is a prime of at
    least 3, so that every step runs through all slots.
    """
    shards = list(shards)
    if not is_prime(slots) or slots < 3:
        raise ValueError("the table needs a prime size of at least 3")
    if not shards or len(set(shards)) < len(shards) or None in shards or len(shards) > min(slots, 65535):
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    n = len(shards)
    wants = preferences(spark, shards, slots)
    one = wants.agg(F.sort_array(F.collect_list(F.struct("turn", "offset", "step", "shard"))).alias("wants"))
    # a probe looks at one slot; no shard looks at a slot twice, so there are n * slots probes at most
    filled = one.select(
        "wants",
        F.expr(
            f"""
            aggregate(
              sequence(1, {n * slots}),
              named_struct('owner', unhex(repeat('0000', {slots})), 'looked', array_repeat(0, {n}), 'claims', 0),
              (s, k) -> if(s.claims >= {slots}, s,
                transform(array(s.claims % {n}), i ->
                  transform(array(cast((wants[i].offset + cast(s.looked[i] as bigint) * wants[i].step) % {slots} as int)), slot ->
                    if(substring(s.owner, 2 * slot + 1, 2) = X'0000',
                      named_struct(
                        'owner', overlay(s.owner placing unhex(lpad(hex(i + 1), 4, '0')) from 2 * slot + 1),
                        'looked', concat(slice(s.looked, 1, i), array(s.looked[i] + 1), slice(s.looked, i + 2, {n})),
                        'claims', s.claims + 1),
                      named_struct(
                        'owner', s.owner,
                        'looked', concat(slice(s.looked, 1, i), array(s.looked[i] + 1), slice(s.looked, i + 2, {n})),
                        'claims', s.claims))
                  )[0]
                )[0])
            ).owner
            """
        ).alias("owner"),
    )
    slot = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    return filled.select("wants", "owner", slot).select(
        "slot", F.expr("wants[cast(conv(hex(substring(owner, 2 * slot + 1, 2)), 16, 10) as int) - 1].shard").alias("shard")
    )


def place(
    docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """(id, slot, shard) for every row of `docs`.

    The key is hashed as text; a NULL key counts as the empty text. Rows of one key share a shard. Nothing is shuffled,
    whatever the distribution of any other column. An empty table gives an empty one.
    """
    table = lookup_table(docs.sparkSession, shards, slots).withColumnRenamed("slot", "at")
    slot = (hashed(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots).cast("int")
    placed = docs.select(F.col(key).alias("id"), slot.alias("slot"))
    # the table has `slots` rows, whatever the data
    return placed.join(F.broadcast(table), F.col("slot") == F.col("at")).select("id", "slot", "shard")


def op8_sharding(docs: DataFrame) -> DataFrame:
    return place(docs).withColumnRenamed("id", "doc_id")


OP8_SQL = f"""
WITH RECURSIVE names AS (
  SELECT i::INT AS turn, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard FROM range(0, {len(SHARDS)}) t(i)),
wants AS (
  SELECT turn, shard, list_transform(range(0, {SLOTS}), lambda j: (
      ('0x' || substr(md5(shard), 1, 12))::BIGINT % {SLOTS}
      + j * (('0x' || substr(md5(shard), 13, 12))::BIGINT % {SLOTS - 1} + 1)) % {SLOTS}) AS slots
  FROM names),
fill AS (
  SELECT 0 AS claims, -1::BIGINT AS slot, -1 AS turn, list_transform(range(0, {SLOTS}), lambda j: true) AS free
  UNION ALL
  SELECT claims + 1, got, turn, list_transform(free, lambda x, i: x AND i <> got + 1)
  FROM (SELECT f.claims, w.turn, f.free, list_filter(w.slots, lambda s: f.free[s + 1])[1] AS got
        FROM fill f JOIN wants w ON w.turn = f.claims % {len(SHARDS)} WHERE f.claims < {SLOTS}))
SELECT d.doc_id, p.slot::INT AS slot, n.shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {SLOTS} AS at FROM documents) d
JOIN (SELECT slot, turn FROM fill WHERE claims > 0) p ON p.slot = d.at JOIN names n ON n.turn = p.turn
"""
