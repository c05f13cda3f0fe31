"""A folded table kept as a few runs of folded micro-batches.

Each micro-batch adds a run. Whenever ``fan`` runs of one level stand side by side they are folded into one of the next
level, so a row is written anew as often as there are levels, and a read opens about ``fan`` runs for each level: a
number that grows with the logarithm of the batches. Runs are immutable folders; which of them count is said by the
newest manifest, a small file put in place by renaming. A batch that is tried again after its manifest stands does
nothing, and one that failed before it replaces what it left, so retries are harmless.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 3  # manifests, and what only they name, that slower readers may still be using


class Manifests:
    """Numbered JSON files in a folder that Spark can write to; the newest one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._dir = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._dir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._dir, name)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._dir):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._dir))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._file(f"{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """(number, content) of the newest one; (-1, {}) if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def put(self, number: int, content: dict) -> None:
        draft, final = self._file(f"{number:012d}.draft"), self._file(f"{number:012d}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(json.dumps(content).encode())
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"{final} could not be put in place")

    def drop(self, number: int, folders: list[str]) -> None:
        """Remove an old manifest and the folders that no other one names."""
        for folder in folders:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)
        self._fs.delete(self._file(f"{number:012d}.json"), False)

    def expire(self, folders: Callable[[dict], set[str]]) -> None:
        """Keep the newest few manifests and what they name."""
        numbers = self.numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        used = set().union(*(folders(self.read(n)) for n in kept)) if old else set()
        for n in old:
            self.drop(n, sorted(folders(self.read(n)) - used))


class Levels:
    """``fold`` takes rows with a ``seq`` column, later runs having larger ones, and gives one row per key without it.

    Folding in steps must give what folding all at once gives.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], fan: int = 2):
        if fan < 2:
            raise ValueError("a level holds two runs at least")
        self.spark, self.path, self.fold, self.fan = spark, path.rstrip("/"), fold, fan
        self.manifests = Manifests(spark, f"{self.path}/manifest")

    def last(self) -> int:
        """The number of the last batch that counts; -1 before the first."""
        return self.manifests.newest()[0]

    def runs(self) -> list[str]:
        """The folders a read opens, oldest first."""
        return [self._folder(r) for r in self.manifests.newest()[1].get("runs", [])]

    def _folder(self, run: list[int]) -> str:
        first, last, _ = run
        return f"{self.path}/runs/{first:012d}-{last:012d}"

    def _rows(self, runs: list[list[int]]) -> DataFrame:
        parts = [self.spark.read.parquet(self._folder(r)).withColumn("seq", F.lit(r[0]).cast("long")) for r in runs]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def apply(self, batch: int, rows: DataFrame) -> None:
        """Add the rows of one micro-batch, one per key; batches come in order, each once or again."""
        last, held = self.manifests.newest()
        if batch <= last:
            return
        runs = [*held.get("runs", []), [batch, batch, 0]]
        rows.write.mode("overwrite").parquet(self._folder(runs[-1]))
        while len(runs) >= self.fan and len({r[2] for r in runs[-self.fan :]}) == 1:
            some = runs[-self.fan :]
            merged = [some[0][0], some[-1][1], some[0][2] + 1]
            self.fold(self._rows(some)).write.mode("overwrite").parquet(self._folder(merged))
            runs[-self.fan :] = [merged]
        self.manifests.put(batch, {"runs": runs})
        self.manifests.expire(lambda m: {self._folder(r) for r in m["runs"]})

    def read(self) -> DataFrame | None:
        """One row per key as of the last batch; None before the first."""
        runs = self.manifests.newest()[1].get("runs", [])
        return self.fold(self._rows(runs)) if runs else None
