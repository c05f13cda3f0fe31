"""Job files and local page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_LIST = (
    "entities array<struct<name:string,domain:string>>, brief string, fields array<string>, "
    "purpose string, entityType string, crossReference boolean, maxFetches int, maxSearches int, "
    "model string, verify boolean"
)


def read_job(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Job objects as rows; ``multi_line`` for one object per file, else one per line."""
    return spark.read.schema(ENTITY_LIST).json(path, multiLine=multi_line)


def read_entities(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per listed entity with its position in the list."""
    jobs = read_job(spark, path, multi_line).select("entities", F.col("_metadata.file_path").alias("job"))
    return jobs.select("job", F.posexplode("entities").alias("pos", "entity")).select(
        "job", "pos", "entity.name", "entity.domain"
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as pages; bytes that are not valid UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )
