"""Writing: event appends, result rows, cache snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from enrichspark.operators.ordered import SLICE_ROWS, running, sliced
from enrichspark.session import scratch_path
from enrichspark.sources.tables import event_rows

EVENT_MONTH = "month"


def append_events(df: DataFrame, path: str) -> None:
    """Append attempts to the log, one folder per month."""
    rows = event_rows(df).withColumn(EVENT_MONTH, F.date_format("ts", "yyyy-MM"))
    rows.write.mode("append").partitionBy(EVENT_MONTH).parquet(path)


def stream_events(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same append from a stream, exactly once."""
    rows = event_rows(df).withColumn(EVENT_MONTH, F.date_format("ts", "yyyy-MM"))
    writer = rows.writeStream.partitionBy(EVENT_MONTH).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path, format="parquet")


def write_rows(rows: DataFrame, summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result rows and their summary, side by side."""
    options = {"header": "true"} if fmt == "csv" else {}
    rows.write.mode("errorifexists").format(fmt).options(**options).save(f"{path}/rows")
    summary.write.mode("errorifexists").format(fmt).options(**options).save(f"{path}/summary")


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version of a cache or state table beside the one being read, never over it.

    Writing the same version again replaces it, so a retried job changes nothing.
    """
    path = f"{root}/v={version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A cache table bucketed by its key: later probes on the key read it without a shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """A table stored bucketed by its key, under a name and in a folder of this call's own.

    Joins on the key leave its rows where they lie: only the other side moves, into as many partitions as there are
    buckets. By default these are the session's shuffle partitions, as Spark deals a join with fewer buckets anew.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    save_bucketed(df, table, key, buckets, scratch_path(spark, name))
    return spark.table(table)


def write_texts(df: DataFrame, path: str, text: str = "text", order: str = "doc_id", file_bytes: int = 32 << 20, slice_rows: int = SLICE_ROWS) -> None:
    """Write texts as plain files of at most ``file_bytes`` bytes; a longer text is a file of its own.

    Lines are in the order of ``order``, whose values differ. Files are cut at running totals of bytes, made on sizes
    alone; then each text moves once, to its file.
    """
    sizes = df.select(F.col(order).alias("_order"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("_bytes"))
    cut = sliced(sizes.withColumn("_all", F.lit(0)), ["_all"], ["_order"], slice_rows)
    totals = running(cut, ["_all"], ["_order"], "_slice", sums={"_end": F.col("_bytes").cast("long")})
    # two half-size blocks: what ends in one block began in it or in the one before
    half = max(1, file_bytes // 2)
    large = F.col("_bytes") > half
    part = F.when(large, F.concat(F.lit("l"), F.col("_order").cast("string"))).otherwise(
        F.concat(F.lit("b"), F.floor(F.col("_end") / half).cast("string"))
    )
    places = totals.select("_order", part.alias("part"))
    rows = df.select(F.col(order).alias("_order"), F.coalesce(F.col(text), F.lit("")).alias("value")).join(places, "_order")
    # a folder is one file: its rows lie in one task, which opens it once
    rows.repartition("part").sortWithinPartitions("part", "_order").select("value", "part").write.partitionBy("part").text(path)
