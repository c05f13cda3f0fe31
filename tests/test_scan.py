from enrichspark.operators import scan

LINES = [
    "all fine",
    "-----begin rsa private key-----",
    "API_KEY = 'abcdefghijklmnopqrstuvwxyz'",
    "api_key = 'abcdefghijklmnopqrstuvwxyz'",
    "TOKEN: your_abcdefghijklmnopqrstuvwxyz",
    "SECRET=<abc> abcdefghijklmnopqrstuvwxyz0123",
    "SECRET=short",
    "see /Users/jo.doe/.env",
    "gh api repos/x/contents/.env",
    "EVAL $(gh api foo)",
    "curl -s http://h/contents/.env",
    "internal-name",
]


def test_rules(rows):
    df = rows([(1, "\n".join(LINES)), (2, "nothing\nhere"), (3, None)], "doc_id long, text string")
    rules = (*scan.DEFAULT_RULES, scan.SECRET_ANY_CASE, *scan.deny_terms("internal-name"))
    got = {(r.line_no, r.rule) for r in scan.leak_scan(df, rules).collect()}
    assert got == {
        (2, "private_key"),
        (3, "secret"),
        (3, "secret_any_case"),
        (4, "secret_any_case"),
        (8, "home_path"),
        (9, "network_key_1"),
        (10, "network_key_2"),
        (11, "network_key_3"),
        (12, "deny_1"),
    }


def test_a_match_never_spans_lines(rows):
    df = rows([(1, "TOKEN=\nabcdefghijklmnopqrstuvwxyz"), (2, "eval x\ngh api y")], "doc_id long, text string")
    assert scan.leak_scan(df).count() == 0


def test_verdict_is_closed(rows):
    df = rows([(1, "clean"), (2, "/Users/jo/x")], "doc_id long, text string")
    got = {r.check: (r.findings, r.passed) for r in scan.leak_verdict(scan.leak_scan(df)).collect()}
    assert got["home_path"] == (1, False) and got["overall"] == (1, False)
    assert got["secret"] == (0, True)
    clean = scan.leak_verdict(scan.leak_scan(df.where("doc_id = 1")))
    assert clean.where("not passed").count() == 0


def test_anchors_mean_lines(rows):
    """A rule with an anchor finds first, middle and last lines alike."""
    lines = ["name-x", "a name-x", "name-x b", "name-x"]
    df = rows([(1, "\n".join(lines))], "doc_id long, text string")

    def found(pattern):
        return sorted(r.line_no for r in scan.leak_scan(df, scan.deny_terms(pattern)).collect())

    assert found("^name-x") == [1, 3, 4]
    assert found("name-x$") == [1, 2, 4]
    assert found(r"\Aname-x\z") == [1, 4]
    assert found(r"\bname-x\b") == [1, 2, 3, 4]
    assert found(r"name-x\s*+$") == [1, 2, 4]
    assert found("(?<!a )name-x(?! b)") == [1, 4]


def test_plain_terms_are_their_own_literal():
    plain, pattern = scan.deny_terms("Internal Name", "a.c")
    assert plain.literals == ("internal name",) and pattern.literals == ()
