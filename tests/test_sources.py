import json

from pyspark.sql import functions as F

from enrichspark import session
from enrichspark.sources import files, sinks, tables

JOB = {
    "entities": [{"name": "Acme", "domain": "acme.com"}, {"name": "Globex", "domain": None}, {"name": "Initech"}],
    "brief": "Find the HQ city.",
    "fields": ["hq_city", "ceo"],
    "entityType": "company",
    "maxFetches": 6,
    "verify": True,
}


def test_entity_list(spark, tmp_path):
    (tmp_path / "job.json").write_text(json.dumps(JOB, indent=2))
    got = files.read_entities(spark, str(tmp_path / "job.json")).orderBy("pos").collect()
    assert [(r.pos, r.name, r.domain) for r in got] == [(0, "Acme", "acme.com"), (1, "Globex", None), (2, "Initech", None)]
    job = files.read_job(spark, str(tmp_path / "job.json")).first()
    assert job.fields == ["hq_city", "ceo"] and job.verify and job.maxFetches == 6


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end")
    (tmp_path / "b.txt").write_text("é")
    got = {r.source.rsplit("/", 1)[1]: r.content for r in files.read_files(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"a.txt": "ok � end", "b.txt": "é"}


def test_event_defaults_and_months(spark, rows, tmp_path):
    df = rows(
        [("r", "fetch", "native", "free", True, "2024-01-31 23:59:59"), ("r", "fetch", "jina", "free", False, "2024-02-01 00:00:00")],
        "run_id string, waterfall string, rung string, tier string, success boolean, at string",
    ).withColumn("ts", F.col("at").cast("timestamp_ntz"))
    sinks.append_events(df, str(tmp_path / "log"))
    sinks.append_events(df, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 4
    row = got.where("rung = 'native'").first()
    assert row.from_cache is False and row.cost_credits == 0 and row.cost_usd == 0 and row.latency_ms is None
    assert {str(r.month) for r in got.select("month").distinct().collect()} == {"2024-01", "2024-02"}


def test_rows_and_summary(spark, rows, tmp_path):
    data = rows([("Acme", "Oslo")], "entity string, hq_city string")
    counts = rows([(1, 0)], "verified int, unverified int")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_rows(data, counts, str(tmp_path / fmt), fmt)
        reader = spark.read.option("header", "true").format(fmt)
        assert reader.load(str(tmp_path / fmt / "rows")).first().hq_city == "Oslo"
        assert int(reader.load(str(tmp_path / fmt / "summary")).first().verified) == 1


def test_snapshots_are_idempotent(spark, rows, tmp_path):
    root = str(tmp_path / "cache")
    for _ in range(2):
        path = sinks.write_snapshot(rows([(1,)], "x int"), root, 1)
    after = sinks.write_snapshot(spark.read.parquet(path).union(rows([(2,)], "x int")), root, 2)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(after).count() == 2


def test_known_companies_are_keyed_on_write(rows):
    df = rows([(1, "A", "https://www.A.com/x", None, None)], "id long, company_name string, domain string, status string, notes string")
    row = tables.known_companies(df, "2024-02-01 00:00:00").first()
    assert row.domain_normalized == "a.com" and row.status == "prior-contact"


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))
    if named:
        assert session.shared_dir(spark) == named.rstrip("/")


def test_checkpoint_cuts_lineage(spark):
    df = session.cut_lineage(spark.range(10).selectExpr("id * 2 as x"))
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
