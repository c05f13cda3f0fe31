"""What must not grow: samples, packs, distance blocks, segments, and rows that must not vanish."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from enrichspark.llm import common, embeddings, language, packing, warc

SCHEMA = "doc_id long, text string"


def train_ids(n):
    import zlib

    out, i = [], 0
    while len(out) < n:
        out += [i] if zlib.crc32(str(i).encode()) % 5 else []
        i += 1
    return out


def test_sample_has_one_row_per_id(spark):
    ids = train_ids(60)
    rows = [(ids[0], f"text {i}") for i in range(5000)] + [(i, f"only {i}") for i in ids[1:]]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1)], "doc_id long, toxic int")
    for n in (60, 40):
        got = common.labelled_sample(spark.createDataFrame(rows, SCHEMA), labels, "toxic", n, "doc_id", "text").collect()
        assert len(got) == len({r.id for r in got}) == n
    assert {r.id: (r.text, r.label) for r in common.labelled_sample(spark.createDataFrame(rows, SCHEMA), labels, "toxic", 60, "doc_id", "text").collect()}[ids[0]] == ("text 0", ids[0] % 2)


def test_sample_is_drawn_among_present_ids(spark):
    ids = train_ids(20_028)
    docs = spark.createDataFrame([(i, f"t {i}") for i in ids[-28:]], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert common.labelled_sample(docs, labels, "toxic", 400, "doc_id", "text").count() == 28
    assert common.labelled_sample(docs.limit(0), labels, "toxic", 400, "doc_id", "text").count() == 0


def test_language_fit_takes_one_row_per_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda windows, labels: seen.append((windows, labels)))
    rows = [(2, "ab " * i, "en") for i in range(1, 3000)] + [(3, "die und " * 30, "de"), (None, "x", "de"), (5, None, "fr")]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_text=4)
    windows, labels = seen[0]
    assert len(windows) == len(labels) <= 8 and set(labels) <= {"en", "de"}


def test_packs_of_rows_without_id_are_bounded(spark):
    rows = [(None, "x" * (i % 50)) for i in range(9000)] + [(7, "y" * (i % 50)) for i in range(9000)] + [(i, "z") for i in range(100, 2100)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), pack_rows=500)
    sizes = [r["count"] for r in got.groupBy(F.shiftright("bin_id", 32)).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 1000 and len(sizes) > 30
    assert got.columns == ["id", "piece", "start", "length", "bin_id", "capacity", "bin_offset"]


def test_distances_are_made_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(300, 8)).tolist()
    x = rng.normal(size=(5000, 8))
    seen = []
    real = embeddings.nearest
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").coalesce(1)
    placed = embeddings.assign(frame, pivots, 0.05).collect()
    own = {r.id: r.cell for r in placed if r.own}
    monkeypatch.setattr(embeddings, "BLOCK", 5000)
    at, cell, mine = real(embeddings.unit(x), embeddings.unit(pivots), 0.05)
    assert own == dict(enumerate(mine.tolist())) and len(placed) == len(at) and not seen
    assert embeddings.MOST_PIVOTS * 256 * 8 < 1 << 26  # bytes of a block


def test_pages_are_written_in_time_linear_in_their_length(spark, tmp_path):
    took = {}
    warc.write_archives(spark.createDataFrame([(0, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "warm"))
    for mb in (2, 16):
        page = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("abcdefgh"), mb << 17).alias("html"))
        began = time.time()
        warc.write_archives(page, str(tmp_path / str(mb)))
        took[mb] = time.time() - began
    assert took[16] < 3 * 8 * max(took[2], 0.3)


def test_a_page_without_its_first_segment_keeps_its_row(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef") for _ in range(5000))
    pages = spark.createDataFrame([(1, "u1", long), (2, "u2", "short")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=1000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    lost = records.filter("not (coalesce(segment, 0) = 1)")
    got = {r.page_id: tuple(r)[1:] for r in warc.page_facts(warc.reassembled(lost)).collect()}
    assert got[1] == (None, None, None, None) and got[2][0] == 5 and got[2][2] == "response"
    assert warc.reassembled(lost).filter("problem = 'missing segment'").count() == 1
