"""Running totals and row numbers over groups too large for one task.

A plain window puts a whole group in one task. Here a group is cut into ordered buckets (a time
slice, a range of positions, ``sliced``): rows are scanned inside their bucket, and each bucket receives what
came before it from a small per-bucket summary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.session import cut_lineage


SLICE_ROWS = 1_000_000


def sliced(
    df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS, out: str = "_slice"
) -> DataFrame:
    """Add the number of the slice a row is in: about ``rows`` neighbours along ``by`` and ``order``.

    Slices follow the data, so neither a hot group nor a burst at one instant makes a large one, as
    long as ``order`` tells rows apart. The table is checkpointed once it has more than one slice,
    so that all later scans see the same cuts.
    """
    n = 1 + df.count() // rows
    if n == 1:
        return df.withColumn(out, F.lit(0))
    return cut_lineage(df.repartitionByRange(n, *by, *order).withColumn(out, F.spark_partition_id()))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    bucket: str,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    before: bool = False,
) -> DataFrame:
    """Add running sums and maxima per group, in ``order``.

    ``bucket`` names a column that never decreases along ``order``; a second scan over the same
    column finds the rows already in place. With ``before`` the current row is left out.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys = [*by, bucket]
    inputs = {f"_in_{n}": c for n, c in {**sums, **maxes}.items()}
    rows = df.withColumns(inputs)

    def total(name: str) -> Column:
        agg = F.sum if name in sums else F.max
        return agg(f"_in_{name}")

    names = [*sums, *maxes]
    summary = rows.groupBy(*keys).agg(*[total(n).alias(f"_in_{n}") for n in names])
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, *[total(n).over(earlier).alias(f"_carry_{n}") for n in names])

    inside = Window.partitionBy(*keys).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    scanned = rows.withColumns({f"_own_{n}": total(n).over(inside) for n in names})

    zero = F.lit(0)
    out = {n: F.coalesce(F.col(f"_carry_{n}"), zero) + F.coalesce(F.col(f"_own_{n}"), zero) for n in sums}
    out |= {n: F.greatest(f"_carry_{n}", f"_own_{n}") for n in maxes}
    helpers = [f"{p}{n}" for n in names for p in ("_in_", "_own_", "_carry_")]
    return scanned.join(carried, keys).withColumns(out).drop(*helpers)


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS, out: str = "rn"
) -> DataFrame:
    """Row numbers from 1 inside each group, whatever the group's size."""
    return running(sliced(df, by, order, rows), by, order, "_slice", sums={out: F.lit(1)}).drop("_slice")


def trailing_blocks(df: DataFrame, rn: str, rows: int, block: int = 50_000) -> DataFrame:
    """Cut numbered groups into blocks, repeating in each the last ``rows - 1`` rows before it.

    A trailing window over (group, ``_block``) is then exact on rows where ``_copy`` is false.
    """
    if rows > block:
        raise ValueError("the trailing window must fit in one block")
    home = F.floor((F.col(rn) - 1) / block)
    near_end = F.pmod(F.col(rn) - 1, F.lit(block)) >= block - (rows - 1)
    own = F.struct(home.alias("_block"), F.lit(False).alias("_copy"))
    copy = F.struct((home + 1).alias("_block"), F.lit(True).alias("_copy"))
    places = F.when(near_end, F.array(own, copy)).otherwise(F.array(own))
    return df.select("*", F.inline(places))


def top_one(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group; Spark keeps one row per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def spread_nulls(key: Column, *salt: str) -> Column:
    """Give rows without a key distinct ones that match nothing, so they do not share a task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*salt).cast("string")))
