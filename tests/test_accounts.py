import pytest

from enrichspark.operators import accounts as A
from enrichspark.sources.tables import known_companies

AS_OF = "2024-02-01 00:00:00"
ENT = "pos long, name string, domain string"


@pytest.fixture()
def known(rows):
    data = [
        (1, "Acme Corp", "acme.com", "customer", "renewed 2026-Q1"),
        (2, "Globex", "globex.io", "prior-prospect", "replied, no meeting"),
        (3, "Initech", "initech.com", "do-not-contact", "legal hold"),
        (4, "Acme Twin", "https://www.acme.com/", "net-new", "later row"),
        (5, "Nameless Domain", None, "customer", None),
        (6, None, "bare.com", "customer", ""),
    ]
    return known_companies(rows(data, "id long, company_name string, domain string, status string, notes string"), AS_OF)


def test_batch_lookup(rows, known):
    df = rows([(0, "a", "acme.com"), (1, "u", "unknown-co.com"), (2, "n", None)], ENT)
    got = {r.pos: (r.status, r.company_name, r.notes) for r in A.check_domains(df, known).collect()}
    assert got == {
        0: ("customer", "Acme Corp", "renewed 2026-Q1"),
        1: ("net-new", None, None),
        2: ("net-new", None, None),
    }


def test_xref(rows, known):
    df = rows(
        [
            (0, "Whatever", "https://www.Acme.com/about"),
            (1, " globex ", None),
            (2, "GLOBEX", "other.com"),
            (3, "Initech", "acme.com"),
            (4, "Unseen", "unseen.com"),
            (5, "nameless domain", ""),
            (6, None, "bare.com"),
            (7, None, None),
            (8, "", "..."),
        ],
        ENT,
    )
    got = {r.pos: (r.internal_status, r.internal_ref, r.internal_note) for r in A.xref(df, known).collect()}
    note = "matched research.known_companies"
    assert got == {
        0: ("customer", "Acme Corp", "renewed 2026-Q1"),
        1: ("prior-prospect", "Globex", "replied, no meeting"),
        2: ("prior-prospect", "Globex", "replied, no meeting"),
        3: ("customer", "Acme Corp", "renewed 2026-Q1"),
        4: ("net-new", "", ""),
        5: ("customer", "Nameless Domain", note),
        6: ("customer", "bare.com", note),
        7: ("net-new", "", ""),
        8: ("net-new", "", ""),
    }
    left = A.suppress(A.xref(df, known))
    assert {r.pos for r in left.collect()} == {1, 2, 4, 7, 8}
    assert A.xref_without_table(df).first().internal_note == "no known-companies DB configured"


def test_suppress_domains(rows, known):
    df = rows([(0, "a", "www.acme.com"), (1, "b", "initech.com"), (2, "c", None), (3, "d", "globex.io")], ENT)
    assert {r.pos for r in A.suppress_domains(df, known).collect()} == {2, 3}


@pytest.mark.parametrize("width", [1, 3, 100_000])
def test_groups(rows, width):
    """Same key for the same raw domain only; lone entities are numbered by groups before them."""
    domains = ["acme.com", None, " ACME.com ", "www.acme.com", "", "b.com", "  ", "acme.com", None]
    got = A.group_by_domain(rows([(i, "n", d) for i, d in enumerate(domains)], ENT), slice_rows=width)
    keys = ["acme.com", "_nodomain_1", "acme.com", "www.acme.com", "_nodomain_3", "b.com", "_nodomain_5", "acme.com", "_nodomain_6"]
    sizes = [3, 1, 3, 1, 1, 1, 1, 3, 1]
    assert sorted((r.pos, r.group_key, r.group_size) for r in got.collect()) == list(zip(range(9), keys, sizes, strict=True))


def test_resolve_once_share_with_all(rows):
    df = rows([(0, "a", "acme.com"), (1, "b", "https://www.acme.com/x"), (2, "c", None), (3, "d", "b.com")], ENT)
    work = {r.canon_domain: (r.pos, r.entities) for r in A.domain_work(df).collect()}
    assert work == {"acme.com": (0, 2), "b.com": (3, 1)}
    facts = rows([("acme.com", "ceo", "Jane")], "canon_domain string, field string, value string")
    assert {(r.pos, r.value) for r in A.share_by_domain(df, facts).collect()} == {(0, "Jane"), (1, "Jane")}


def test_entities_without_a_domain_do_not_share_a_task(rows, known):
    """Rows without a key get distinct ones: a third of the table may lack a domain."""
    from pyspark.sql import functions as F

    from enrichspark.functions.keys import canon_domain
    from enrichspark.operators.ordered import spread_nulls

    df = rows([(i, "n", None if i % 3 == 0 else f"d{i}.com") for i in range(300)], ENT)
    keys = df.select(spread_nulls(canon_domain(F.col("domain")), "pos").alias("k"))
    assert keys.distinct().count() == 300
