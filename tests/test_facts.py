import pytest
from pyspark.sql import functions as F

from enrichspark.functions.keys import url_key
from enrichspark.operators import facts as X

SCHEMA = "entity_name string, field string, value string, source_url string, verified boolean, note string"


@pytest.fixture()
def pages(rows):
    df = rows(
        [
            ("https://acme.com/about", "Acme is based in\n  Oslo, Norway. It has 50 staff! Who leads it?\nJane Roe."),
            ("https://b.com/", ""),
        ],
        "url string, content string",
    )
    return df.withColumn("url_key", url_key(F.col("url")))


def test_claims_are_checked_on_the_stored_page(rows, pages):
    claims = rows(
        [
            (1, "https://acme.com/about#x", "based in Oslo", "Oslo"),
            (2, "HTTPS://acme.com:443/about/?utm_source=z", "BASED  in oslo", "Oslo"),
            (3, "https://acme.com/about", "based in Paris", "Paris"),
            (4, "https://unknown.com/", "based in Oslo", "Oslo"),
            (5, "https://acme.com/about", "", "Oslo"),
            (6, "https://b.com/", "x", "x"),
            (7, "https://acme.com/about", None, "x"),
        ],
        "id int, source_url string, quote string, value string",
    )
    checked = X.verify_claims(claims, pages)
    assert {r.id for r in X.trusted(checked).collect()} == {1, 2}
    blanked = {r.id: (r.value, r.note) for r in X.blank_unverified(checked).collect()}
    assert blanked[1] == ("Oslo", "")
    assert blanked[3] == ("", "NOT FOUND — searched https://acme.com/about")


def test_status(rows):
    df = rows(
        [
            ("e", "f", "v", "u", True, ""),
            ("e", "f", "", "u", False, "NOT FOUND — searched u"),
            ("e", "f", "v", "u", False, "UNVERIFIED guess"),
            ("e", "f", "v", "", True, ""),
            ("e", "f", "", "u", True, ""),
            ("e", "f", "v", "u", False, ""),
            ("e", "f", None, None, None, None),
        ],
        SCHEMA,
    )
    got = [r.fact_status for r in X.classify_facts(df).collect()]
    assert got == ["verified", "not_found", "unverified"] + ["violation"] * 4
    assert X.violations(df).count() == 4


def test_sources(rows):
    df = rows(
        [
            ("e", "hq", "Oslo", "https://a.com/1", True, ""),
            ("e", "hq", "Oslo", "https://A.com/2", True, ""),
            ("e", "ceo", "Jane", "https://a.com/1", True, ""),
            ("e", "ceo", "Jane", "https://www.acme.com/1", True, ""),
            ("e", "n", "5", "https://a.com/", True, ""),
            ("e", "n", "5", "https://b.com/", False, ""),
        ],
        SCHEMA,
    )
    assert [(r.field, r.sources) for r in X.two_sources(df).collect()] == [("ceo", 2)]
    own = rows([("e", "acme.com")], "entity_name string, domain string")
    best = {r.field: (r.source_url, r.primary_source) for r in X.rank_sources(df, own).collect()}
    assert best["ceo"] == ("https://www.acme.com/1", True)
    assert best["hq"] == ("https://A.com/2", False)


def test_output_shapes(rows):
    df = rows(
        [
            ("e1", "hq", "Oslo", "u1", True, ""),
            ("e1", "ceo", "Jane", "u2", True, ""),
            ("e1", "ceo", "Zoe", "u3", True, ""),
            ("e2", "hq", "Rome", "u1", False, ""),
        ],
        SCHEMA,
    )
    wide = {r.entity_name: (r.hq, r.hq_source, r.ceo, r.ceo_source) for r in X.pivot_facts(df, ["hq", "ceo"]).collect()}
    assert wide == {"e1": ("Oslo", "u1", "Jane", "u2"), "e2": ("Rome", "u1", None, None)}
    full = df.withColumns({"domain": F.lit("e1.com"), "internal_status": F.lit("net-new")})
    canon = X.to_canonical(full, ["hq", "ceo"]).collect()
    assert len(canon) == 1 and canon[0].intel == {"hq": "Oslo", "ceo": "Jane"}
    assert canon[0].sources == ["u1", "u2", "u3"] and canon[0].db_status == "net-new"


def test_quotes(rows, pages):
    wants = pages.select("url_key", F.lit("hq").alias("field"), F.array(F.lit("OSLO"), F.lit("norway")).alias("terms")).unionByName(
        pages.select("url_key", F.lit("boss").alias("field"), F.array(F.lit("founder")).alias("terms"))
    )
    got = X.extract_quotes(pages, wants)
    seen = {(r.field, r.quote, r.found) for r in got.join(pages.where("content <> ''"), "url_key").collect()}
    assert seen == {("hq", "Oslo, Norway.", True), ("boss", "ABSENT", False)}
    digest = X.quotes_as_digest(got.where("found")).collect()
    assert [r.digest for r in digest] == ["hq: Oslo, Norway."]
