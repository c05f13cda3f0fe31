import hashlib

import pytest
from pyspark.sql import functions as F

from enrichspark.functions import keys
from enrichspark.sources.derived import AS_OF
from enrichspark.sources.tables import known_companies

URLS = [
    ("https://Acme.com/About/", "https://acme.com/About"),
    ("  HTTP://ACME.com:80  ", "http://acme.com/"),
    ("https://acme.com:443/a//", "https://acme.com/a"),
    ("http://acme.com:443/a", "http://acme.com:443/a"),
    ("https://acme.com:8443/a", "https://acme.com:8443/a"),
    ("https://acme.com:0/a", "https://acme.com/a"),
    ("https://user:pw@acme.com/a", "https://acme.com/a"),
    ("https://acme.com/a?utm_source=x&b=2&gclid=1&a=1", "https://acme.com/a?b=2&a=1"),
    ("https://acme.com/a?UTM_source=x", "https://acme.com/a?UTM_source=x"),
    ("https://acme.com/a?gclids=1&xutm_=2", "https://acme.com/a?gclids=1&xutm_=2"),
    ("https://acme.com/a?flag&e=&x=a=b", "https://acme.com/a?flag=&e=&x=a%3Db"),
    ("https://acme.com/a?q=a+b%20c~*", "https://acme.com/a?q=a+b+c~%2A"),
    ("https://acme.com/a?q=50%25%zz", "https://acme.com/a?q=50%25%25zz"),
    ("https://acme.com/a?q=é", "https://acme.com/a?q=%C3%A9"),
    ("https://acme.com/a?&&b=1&", "https://acme.com/a?b=1"),
    ("https://acme.com/a?utm_x=1#frag?no=1", "https://acme.com/a"),
    ("https://acme.com#top?x=1", "https://acme.com/"),
    ("https://acme.com?x=1/2", "https://acme.com/?x=1%2F2"),
    ("https://a_b.com/x", "https://a_b.com/x"),
    ("//acme.com/x", "https://acme.com/x"),
    ("acme.com/about", "https:acme.com/about"),
    ("https://[::1]:8080/x", "https://::1:8080/x"),
    ("", "https:///"),
    ("https://acme.com/ca\tt", "https://acme.com/cat"),
]


@pytest.mark.parametrize("pair", [URLS], ids=["all"])
def test_canon_url(one, pair):
    got = one(keys.canon_url, *[u for u, _ in pair])
    assert got == [want for _, want in pair]


def test_canon_url_rejects_bad_ports(one):
    assert one(keys.canon_url, "https://a.com:99999/", "https://a.com:x/") == [None, None]


def test_canon_url_is_idempotent(one):
    first = one(keys.canon_url, *[u for u, _ in URLS if "[" not in u])
    assert one(keys.canon_url, *first) == first


def test_url_variants_share_a_key(one):
    got = one(keys.url_key, "https://acme.com/a", "HTTPS://ACME.COM:443/a/?utm_medium=x#y")
    assert got[0] == got[1] == hashlib.sha256(b"https://acme.com/a").hexdigest()


def test_canon_query(one):
    assert one(keys.canon_query, "  Big\tCo   News\n", None, "é É") == ["big co news", "", "é é"]


def test_query_key_names_the_rung(one):
    want = hashlib.sha256(b"search|big co").hexdigest()
    assert one(keys.query_key, " Big  CO ") == want


DOMAINS = [
    ("https://www.Acme.com/", "acme.com"),
    ("acme.com", "acme.com"),
    ("http://acme.com./x", "acme.com"),
    ("www.www.acme.com", "www.acme.com"),
    ("acme.com:8080/x", "acme.com:8080"),
    ("\tacme.com\n", "acme.com"),
    ("ftp://acme.com", "ftp:"),
    ("https://", None),
    ("...", None),
    ("", None),
    (None, None),
]


def test_canon_domain(one):
    assert one(keys.canon_domain, *[d for d, _ in DOMAINS]) == [want for _, want in DOMAINS]


def test_sql_functions(spark, rows):
    """Published example: one account found, one domain unknown."""
    known = rows(
        [
            (1, "Acme Corp", "https://www.acme.com/", "customer", "renewed 2026-Q1"),
            (2, "Globex", "globex.io", "prior-prospect", "replied"),
            (3, "Initech", "initech.com", None, None),
        ],
        "id long, company_name string, domain string, status string, notes string",
    )
    known_companies(known, AS_OF).createOrReplaceTempView("known_view")
    keys.register_sql_functions(spark, "known_view")
    assert spark.sql("select normalize_company_domain(' https://www.Acme.com/x ')").first()[0] == "acme.com"
    got = spark.sql("select * from check_company_domains(array('acme.com', 'unknown-co.com', 'initech.com'))")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("acme.com", "customer", "Acme Corp", "renewed 2026-Q1"),
        ("initech.com", "prior-contact", "Initech", None),
        ("unknown-co.com", "net-new", None, None),
    ]


def test_table_form_equals_column_form(rows):
    df = rows([(u,) for u, _ in URLS] + [("https://a.com:x/",), (None,)], "url string")
    got = keys.with_url_key(keys.with_canon_url(df)).select(
        "canon_url", keys.canon_url(F.col("url")).alias("c"), "url_key", keys.url_key(F.col("url")).alias("k")
    )
    for r in got.collect():
        assert r.canon_url == r.c and r.url_key == r.k and len(r.url_key) == 64


def test_long_queries(one):
    query = "&".join(f"a{i}={i}" for i in range(5000))
    assert one(keys.canon_url, f"https://a.com/?{query}&gclid=1") == f"https://a.com/?{query}"


def test_bad_addresses_get_keys_of_their_own(one):
    got = one(keys.url_key, "https://a.com:x/", "https://a.com:y/", "https://a.com/")
    assert len(set(got)) == 3
