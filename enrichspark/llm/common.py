"""What the corpus operators share: tables, stored intermediate results, splits, links into groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back: later jobs do not redo its work,
    and a lost executor takes nothing of it along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    names = {c.lower() for c in df.columns}
    return stem if stem not in names else f"{stem}_{uuid.uuid4().hex[:8]}"


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n: the splits of training and held-out rows. NULL for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def sample_order(key: Column) -> Column:
    """A fixed pseudo-random order of rows, the same on every machine."""
    return F.xxhash64(key.cast("string"))


def chunks(texts, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of texts that hold about `limit` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links that join the same nodes as the links (a, b): each node with the smallest of its group."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node reachable.

    Alternates large and small stars: in each round every node links its larger neighbours, then its
    smaller ones, to the smallest neighbour it knows. Rows stay as many as the links, no group is
    gathered in one task (only minima are taken), and each round is written to the shared folder.
    Nodes that occur in no link are not returned; loops and repeated links do no harm.
    """
    spark = links.sparkSession
    edges = links.select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    ).filter("hi > lo").distinct()
    edges = stored(edges, name)
    while True:
        # large star: strictly larger neighbours go to the smallest one
        both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("hi", "m").alias("m"))
        # an edge (hi, lo) is seen from lo: hi is the larger neighbour, and joins lo's smallest one
        large = (
            edges.join(low, edges["lo"] == low["node"])
            .select("hi", F.col("m").alias("lo"))
            .filter("hi > lo")
            .distinct()
        )
        # small star: smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        new = stored(small.select("e.*").filter("hi > lo").distinct(), name)
        # done once every node has one link, to a node that has none
        open_ = new.groupBy("hi").count().filter("count > 1").limit(1).count() or (
            new.join(new.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count()
        )
        edges = new
        if not open_:
            break
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stored(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), name)


def map_texts(df: DataFrame, text: str, carry: list[Column], fields: str, make, limit: int = 1 << 21) -> DataFrame:
    """`carry` columns beside `fields`, computed from each text in Python.

    `make()` gives, once per task, a function from a list of texts to a list of columns, one per field. It is called
    on runs of texts of about `limit` characters, so memory does not follow the length of a batch. Carried columns
    pass through as they are, NULLs included.
    """
    source = df.select(F.col(text).cast("string").alias(f"text_{uuid.uuid4().hex}"), *carry)
    kept = source.columns[1:]
    schema = df.sparkSession.createDataFrame([], fields).schema
    names = [*kept, *schema.names]
    # plain names on the way: a Python map takes none with a dot, and carried names may be alike
    source = source.toDF("text", *(f"c{i}" for i in range(len(kept))))
    out = type(schema)([*source.schema.fields[1:], *(type(f)(f"f{i}", f.dataType) for i, f in enumerate(schema.fields))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        given = to_arrow_schema(out)
        work = make()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, limit):
                got = work(texts[a:b])
                columns = [batch.column(i + 1).slice(a, b - a) for i in range(len(kept))]
                columns += [pa.array(v, given.field(len(kept) + i).type) for i, v in enumerate(got)]
                yield pa.RecordBatch.from_arrays(columns, names=given.names)

    return source.mapInArrow(run, out).toDF(*names)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str, text: str) -> DataFrame:
    """(id, text, label) of at most `rows` labelled training documents, in a fixed pseudo-random order of their ids.

    Training ids are those whose crc32 is not 0 modulo 5. They are drawn among the labelled ids that `docs` has, without
    texts; the drawn table has `rows` rows at most and is broadcast. Each id gives one row: of several texts the least
    one, of several labels the smaller one.
    """
    have = docs.select(F.col(key).alias("have")).distinct()
    drawn = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key), 5) != 0))
        .groupBy(F.col(key).alias("sample_id"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
        .join(have, F.col("sample_id") == F.col("have"), "left_semi")
        .orderBy(sample_order(F.col("sample_id")), "sample_id")
        .limit(rows)
    )
    return (
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(drawn), F.col("id") == F.col("sample_id"))
        .groupBy("id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))
    )
