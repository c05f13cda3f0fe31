"""Exact near-duplicate embeddings by a range join over pivots.

On vectors of length 1, cosine >= c is Euclidean distance <= r with r * r = 2 - 2c. Every vector belongs to the cell of
its nearest pivot. If b lies within r of a, and a's cell is i and b's is j, then d(b, p_i) <= d(a, p_i) + r
<= d(a, p_j) + r <= d(b, p_j) + 2r, by the triangle inequality: so b need be copied only into cells whose pivot is at
most 2r farther than its own, and of two cells only into the one of lower number. Cells then join independently, by
blocked matrix products in double precision, and lose no pair.

Cells are cut into tiles of bounded size, so that neither a hot cell nor its copied boundary has to fit one task. A
task gives for each vector its number of links and one link towards the smallest of its group, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import components, sample_order, spanning, stored

MOST_PIVOTS = 1 << 14
BLOCK = 256  # vectors compared with all pivots at a time: 34 MB of distances at most
COPIES = 1 << 14  # rows given out at a time
SLACK = 1e-6  # for rounding of distances; it only copies more


def unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector) -> "F.Column":
    """Not NULL, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of each vector's own cell and of the lower ones within reach; own cell of each row."""
    distance = x @ centres.T
    distance *= -2
    distance += 2
    np.sqrt(np.maximum(distance, 0, out=distance), out=distance)
    own = distance.argmin(axis=1)
    reach = distance <= distance[np.arange(len(x)), own, None] + 2 * radius + SLACK
    reach &= np.arange(len(centres)) <= own[:, None]
    return *np.nonzero(reach), own


def assign(vectors: DataFrame, pivots: list[list[float]], radius: float) -> DataFrame:
    """(id, vector, size, cell, own): each vector in its cell, and copied into lower cells within reach.

    Distances are made for `BLOCK` vectors at a time, so a task holds BLOCK x pivots of them whatever its batches are.
    """
    by_size: dict[int, list] = {}
    for p in pivots:
        by_size.setdefault(len(p), []).append(p)
    shared = vectors.sparkSession.sparkContext.broadcast({n: unit(p) for n, p in by_size.items()})
    fields = vectors.schema.fields

    def place(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                held = np.flatnonzero(sizes == n)
                centres = known.get(n, np.eye(1, n))
                for k in range(0, len(held), BLOCK):
                    rows = held[k : k + BLOCK]
                    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                    at, cell, own = nearest(unit(flat.reshape(len(rows), n)), centres, radius)
                    for a in range(0, len(at), COPIES):  # a vector may go to every lower cell
                        some = slice(a, a + COPIES)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(rows[at[some]])),
                                column.take(pa.array(rows[at[some]])),
                                pa.array(np.full(len(at[some]), n, np.int32)),
                                pa.array(cell[some].astype(np.int32)),
                                pa.array(own[at[some]] == cell[some]),
                            ],
                            names=["id", "vector", "size", "cell", "own"],
                        )

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(("id", "vector"), fields))
    return vectors.mapInArrow(place, f"{kinds}, size int, cell int, own boolean")


def tiled(placed: DataFrame, tile_rows: int) -> DataFrame:
    """A row for each task a vector takes part in: (size, cell, a, b, left, id, vector).

    The rows of a cell are dealt into tiles by a hash of their id; own tiles meet each other and, on the left, every
    tile of copies. Counts by cell are bounded by the number of pivots.
    """
    counted = placed.groupBy("size", "cell").agg(
        F.ceil(F.count(F.when(F.col("own"), 1)) / tile_rows).cast("int").alias("owns"),
        F.ceil(F.count(F.when(~F.col("own"), 1)) / tile_rows).cast("int").alias("copies"),
    )
    rows = placed.join(F.broadcast(counted), ["size", "cell"])  # a row per cell, at most MOST_PIVOTS for each size
    mixed = F.xxhash64("id")
    tile = F.when(F.col("own"), F.pmod(mixed, "owns")).otherwise(F.col("owns") + F.pmod(mixed, F.greatest("copies", F.lit(1)))).cast("int")
    rows = rows.withColumn("tile", tile)

    def pair(a, b, left):
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(left).alias("left"))

    every, t = F.sequence(F.lit(0), F.col("owns") + F.col("copies") - 1), F.col("tile")
    as_left = F.transform(F.filter(every, lambda x: F.col("own") & (x >= t)), lambda x: pair(t, x, True))
    as_right = F.transform(F.filter(every, lambda x: (x < t) & (x < F.col("owns"))), lambda x: pair(x, t, False))
    return rows.select("size", "cell", "id", "vector", F.explode(F.concat(as_left, as_right)).alias("p")).select(
        "size", "cell", "p.a", "p.b", "p.left", "id", "vector"
    )


def links(tasks: DataFrame, least: float, block: int = 512) -> DataFrame:
    """(id, n, root): of each task and each vector with links in it, their number and the smallest id of its group."""
    kind = tasks.schema["id"].dataType.simpleString()

    def join(key, table):
        import pyarrow as pa

        empty = pa.table({"id": pa.array([], table.schema.field("id").type), "n": pa.array([], pa.int64()), "root": pa.array([], table.schema.field("id").type)})
        size, alone = key[0].as_py(), key[2] == key[3]
        ids = table["id"].to_numpy()
        x = unit(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size))
        left = table["left"].to_numpy(zero_copy_only=False).astype(bool)
        one, two = np.flatnonzero(left), np.flatnonzero(left if alone else ~left)
        found = []
        for k in range(0, len(one), block):
            near = x[one[k : k + block]] @ x[two].T >= least
            if alone:  # each pair once
                near &= np.arange(k, k + len(near))[:, None] < np.arange(len(two))[None, :]
            i, j = np.nonzero(near)
            i, j = ids[one[k + i]], ids[two[j]]
            found.append(np.stack([i, j])[:, i != j])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        if not len(a):
            return empty
        nodes, n = np.unique(np.concatenate([a, b]), return_counts=True)
        root = nodes.copy()
        below, low = spanning(a, b)
        root[np.searchsorted(nodes, below)] = low
        return pa.table({"id": nodes, "n": n.astype(np.int64), "root": root}).cast(empty.schema)

    return tasks.groupBy("size", "cell", "a", "b").applyInArrow(join, f"id {kind}, n long, root {kind}")


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    least: float = 0.95,
    cell_rows: int = 2048,
    tile_rows: int = 2048,
) -> DataFrame:
    """(id, n_links, component): one row per id; n_links other vectors lie at cosine >= `least`.

    Vectors that are NULL, empty, zero or hold a NULL or non-finite component link with nothing, nor do vectors of
    different lengths with each other; each is its own component. Repeated rows count once; if an id has several
    different vectors it links by each of them, and n_links counts those links. Rows without id link nothing and come
    back as one row with a NULL component. An empty table gives an empty one.

    One pivot for each `cell_rows` vectors is drawn, 16,384 at most: beyond that cells only get more tiles.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    sound = stored(rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).distinct(), "embeddings")
    wanted = min(MOST_PIVOTS, math.ceil(sound.count() / cell_rows))
    drawn = sound.orderBy(sample_order(F.col("id")), "id").limit(wanted).collect()  # bounded by MOST_PIVOTS
    placed = stored(assign(sound, [list(map(float, r["vector"])) for r in drawn], math.sqrt(2 - 2 * least)), "cells")
    found = stored(links(tiled(placed, tile_rows), least), "embedding-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "embedding-groups")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links")).withColumnRenamed("id", "linked")
    return (
        rows.select("id")
        .distinct()
        .join(counts, F.col("id") == F.col("linked"), "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "id").alias("component"))
    )


def op5_embedding_near_dedup(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


OP5_SQL = """
WITH RECURSIVE sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
walk(id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT walk.id, linked.b FROM walk JOIN linked ON walk.reached = linked.a),
roots AS (SELECT id, min(reached) AS root FROM walk GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT r.id AS vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.root AS component_id, r.id = r.root AS kept
FROM roots r LEFT JOIN counts c ON c.a = r.id
"""
