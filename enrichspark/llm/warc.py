"""WARC archives: writing pages as records in segments, and reading them back whole.

A page is an HTTP response with chunked transfer framing in a `response` record. Of pages with equal payloads only the
one with the largest id is a response; the others are `revisit` records that refer to it. A record longer than the
segment size is cut: the first segment keeps the record's type and has segment number 1, the others are `continuation`
records that name their origin, and the last one has the total length. Records are written with Spark's text writer,
whose line end is the blank lines that close a record, so files go wherever Spark writes, and each holds a bounded
number of segments.

Reading parses each file by its records' own lengths, groups continuation records by their origin's identifier, orders
them by segment number, verifies the numbers and the total length, and takes the chunked framing off.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark.llm.common import stored
from enrichspark.session import scratch_path

END = "\r\n\r\n"  # ends a record, and a head within one
HTTP_HEAD = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{END}"
REVISIT_HEAD = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, kind string, uri string, refers_to string, origin string, segment int, total long, block binary"


def _binary(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("binary")


def _cut(data: Column, size: int) -> Column:
    """A binary value in parts of `size` bytes; one empty part if it is empty."""
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.substring(data, k * size + 1, size))


def chunked(payload: Column, size: int) -> Column:
    """A payload in chunks with their lengths, closed by an empty chunk."""

    def framed(part):
        return F.when(F.octet_length(part) > 0, F.concat(_binary(F.concat(F.lower(F.hex(F.octet_length(part))), F.lit("\r\n"))), part, _binary("\r\n"))).otherwise(_binary(""))

    # hexadecimal text doubles as a joinable form of binary
    return F.concat(F.unhex(F.array_join(F.transform(_cut(payload, size), lambda p: F.hex(framed(p))), "")), _binary("0" + END))


def record_id(key: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, digest, first): pages whose payload, of `least_bytes` or more, a page with a larger id has too."""
    large = pages.filter(F.col("id").isNotNull() & (F.octet_length("payload") >= least_bytes)).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.max("id").alias("first"), F.min("id").alias("last")).filter("first > last")
    return large.join(firsts.select(F.col("digest").alias("shared"), "first"), F.col("digest") == F.col("shared")).filter("id < first").select("id", "digest", "first").distinct()


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    uri: str = "url",
    html: str = "html",
    least_bytes: int = 1000,
    segment_bytes: int = 8192,
    chunk_bytes: int = 4096,
    date: str = "2024-01-01T00:00:00Z",
    broadcast_rows: int = 100_000,
) -> None:
    """Write one record per page to gzip-compressed WARC files under `path`.

    NULL html is an empty payload; a NULL uri is left out. Pages without id are records of their own that are never
    revisits or referred to. Repeated rows are written as often as they occur, under one record id. An empty table writes
    no record. Payloads of fewer than `least_bytes` bytes are never revisits. A file holds 1,024 segments at most, of
    `segment_bytes` bytes of block each.
    """
    data = pages.select(F.col(key).alias("id"), F.col(uri).alias("uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    data = data.withColumn("digest", F.sha1("payload"))
    again = stored(revisits(data, least_bytes), "revisits")
    again = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    if again.count() <= broadcast_rows:
        again = F.broadcast(again)
    marked = data.join(again, (F.col("id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    is_revisit = F.col("first").isNotNull()
    safe = F.regexp_replace("uri", r"[\x00-\x20\x7f]", "_")  # a header is one line
    block = F.when(is_revisit, _binary(REVISIT_HEAD)).otherwise(F.concat(_binary(HTTP_HEAD), chunked(F.col("payload"), chunk_bytes)))
    segments = marked.select(
        record_id(F.col("id"), F.col("digest")).alias("record_id"),
        F.when(is_revisit, record_id(F.col("first"), F.col("digest"))).alias("refers_to"),
        "digest",
        safe.alias("uri"),
        block.alias("block"),
    ).withColumn("total", F.octet_length("block"))
    # the block itself does not ride beside its parts
    heads = ["record_id", "refers_to", "digest", "uri", "total"]
    segments = segments.select(*heads, F.posexplode(_cut(F.col("block"), segment_bytes)).alias("k", "part"))
    segments = segments.withColumn("n", F.ceil(F.col("total") / segment_bytes))
    cut, later = F.col("n") > 1, F.col("k") > 0

    def line(name: str, value: Column, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))).otherwise(F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(later, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"),
        line("WARC-Record-ID", F.when(later, F.concat(F.rtrim(F.col("record_id"), F.lit(">")), F.lit(";"), F.col("k") + 1, F.lit(">"))).otherwise(F.col("record_id")), F.lit(True)),
        line("WARC-Date", F.lit(date), F.lit(True)),
        line("WARC-Target-URI", F.col("uri"), F.col("uri").isNotNull() & ~later),
        line("Content-Type", F.lit("application/http; msgtype=response"), ~later),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), ~later),
        line("WARC-Refers-To", F.col("refers_to"), F.col("refers_to").isNotNull()),
        line("WARC-Profile", F.lit(PROFILE), F.col("refers_to").isNotNull()),
        line("WARC-Segment-Number", F.col("k") + 1, cut),
        line("WARC-Segment-Origin-ID", F.col("record_id"), later),
        line("WARC-Segment-Total-Length", F.col("total"), later & (F.col("k") + 1 == F.col("n"))),
        line("Content-Length", F.octet_length("part"), F.lit(True)),
        F.lit(END),
    )
    # bytes pass through a text column as they are
    rows = segments.select(F.concat(head.cast("binary"), F.col("part")).cast("string").alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1024).text(path)


def inflated(data: bytes) -> bytes:
    """All members of gzip data; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def parse_records(data: bytes, path: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; header names in lower case."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        head = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if stop < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"{path}: no record at byte {at}")
        fields = {}
        for each in head[1:]:
            name, _, value = each.partition(":")
            fields[name.strip().lower()] = value.strip()
        begin = stop + len(end)
        at = begin + int(fields["content-length"])
        if at > len(data):
            raise ValueError(f"{path}: record at byte {begin} is cut off")
        yield fields, data[begin:at]
        at += len(end)


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken."""
    at, out = 0, []
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def decoded(block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of an HTTP response."""
    head, found, body = block.partition(END.encode())
    if not found:
        return None, "no HTTP header"
    if b"transfer-encoding: chunked" in head.lower():
        payload = unchunked(body)
        return (payload, None) if payload is not None else (None, "broken chunk framing")
    return body, None


def _columns(rows: list[tuple], schema):
    import pyarrow as pa

    values = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`: a segment's `origin` is its record, `total` is on the last one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = spark.createDataFrame([], RECORD).schema

    def parse(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for head, block in parse_records(inflated(content.as_py()), name):
                    segment = int(head.get("warc-segment-number", 0))
                    origin = head.get("warc-segment-origin-id") or (head["warc-record-id"] if segment else None)
                    total = head.get("warc-segment-total-length")
                    rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), origin, segment or None, total and int(total), block))
                yield _columns(rows, schema)

    return files.mapInArrow(parse, out)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, kind, uri, refers_to, payload, problem): one row per whole record that is not a continuation.

    Segments are grouped by origin, so a task holds the segments of one record at a time. A repeated segment counts
    once. `problem` says what is wrong with a record whose payload is NULL for it: a segment is missing, the total
    length differs, or the HTTP head or chunk framing is broken. Revisits have an empty payload and no problem.
    """
    part = F.struct("segment", "kind", "uri", "refers_to", "total", "block")
    grouped = records.filter("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    whole = records.filter("origin is null").select(F.col("record_id").alias("origin"), F.array(part).alias("parts"))
    out = records.sparkSession.createDataFrame([], "record_id string, kind string, uri string, refers_to string, payload binary, problem string").schema

    def join(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            for origin, parts in zip(batch.column(0), batch.column(1)):
                parts = list({p["segment"]: p for p in parts.as_py()}.values())
                first, last = parts[0], parts[-1]
                payload, problem = None, None
                block = b"".join(p["block"] for p in parts)
                if first["segment"] is not None:
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or last["total"] is None:
                        problem = "missing segment"
                    elif last["total"] != len(block):
                        problem = "wrong total length"
                if problem is None:
                    payload, problem = decoded(block)
                kind = first["kind"] if first["kind"] != "continuation" else None
                yield _columns([(origin.as_py(), kind, first["uri"], first["refers_to"], payload, problem)], schema)

    return whole.union(grouped).mapInArrow(join, out)


def op1_warc(pages: DataFrame) -> DataFrame:
    """Per page what the archives give back; a page of a broken record has NULL payload columns, and a NULL type too if
    its first segment is lost."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    read = reassembled(read_records(spark, path))
    return page_facts(read)


def page_facts(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of reassembled records, one row per record id."""
    facts = records.select(
        "record_id",
        F.expr("nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]*):', 1), '')").cast("long").alias("page_id"),
        F.col("kind").alias("record_type"),
        "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    facts = stored(facts, "warc-facts").dropDuplicates(["record_id"])
    again = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    plain = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    own = facts.filter(~again).select(*plain, F.lit(None).cast("long").alias("refers_to"))
    # a revisit's payload is that of the record it refers to
    kept = facts.filter("record_type = 'response'").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("target_page"), F.col("payload_bytes").alias("target_bytes"), F.col("payload_digest").alias("target_digest")
    )
    again = (
        facts.filter(again)
        .join(kept, F.col("refers_to") == F.col("target"), "left")
        .select("page_id", F.col("target_bytes").alias("payload_bytes"), F.col("target_digest").alias("payload_digest"), "record_type", F.col("target_page").alias("refers_to"))
    )
    return own.union(again)


OP1_SQL = """
WITH p AS (SELECT DISTINCT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN p.page_id < f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest AND p.n >= 1000
"""
