from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions import text


def test_html_text(one):
    page = (
        "<!DOCTYPE html><html><head><title> T &amp; Co </title><style>p{}</style>"
        "<script>var a = '<p>no</p>';</script></head><body><!-- gone <b>x</b> -->\n"
        "<p>one <b>two</b>three</p><svg><text>no</text></svg><noscript>no</noscript>"
        "<p>  &lt;kept&gt; 1 < 2 </p></body></html>"
    )
    want = "T & Co\none\ntwo\nthree\n<kept> 1 < 2"
    assert one(lambda c: text.html_text(c, "named"), page) == want
    assert one(lambda c: text.html_text(c, "full"), page) == want
    assert one(lambda c: text.html_text(c, "raw"), page) == page


def test_only_full_mode_knows_every_entity(one):
    assert one(lambda c: text.html_text(c, "full"), "<p>&eacute;&#8364;&hellip;</p>", None) == ["é€…", None]


def test_unclosed_script_hides_the_rest(one):
    assert one(lambda c: text.html_text(c, "named"), "<p>a</p><SCRIPT>b</p>") == "a"


def test_usable(one):
    long_ = "x" * 500
    cases = [
        (long_, True),
        ("  " + "x" * 499 + "  ", False),
        (long_ + " Please ENABLE JavaScript", False),
        ("x" * 3000 + " captcha", True),
        ("x" * 2000 + " captcha", False),
        (None, False),
        ("", False),
    ]
    assert one(text.usable, *[c for c, _ in cases]) == [w for _, w in cases]


def test_dead_and_shell(rows):
    df = rows(
        [
            (1, True, 200, "short"),
            (2, True, 200, "  "),
            (3, False, 404, "gone"),
            (4, False, 403, "no"),
            (5, True, 200, "x" * 600),
            (6, False, None, ""),
        ],
        "id int, ok boolean, status int, content string",
    )
    got = text.with_shell(text.with_dead(df, "status")).orderBy("id").collect()
    assert [r.is_dead for r in got] == [False, False, True, False, False, False]
    assert [r.is_js_shell for r in got] == [True, False, False, True, False, False]


def test_length_rules(one):
    n = C.DIGEST_THRESHOLD
    fresh = lambda c: text.needs_digest(c, F.lit(False))
    assert one(fresh, "x" * n, "x" * (n + 1)) == [False, True]
    assert one(lambda c: text.needs_digest(c, F.lit(True)), "x" * (n + 1)) is False
    cut = one(text.truncated, "x" * (n + 1))
    assert cut == "x" * n + "\n\n[...truncated; digest unavailable...]"
    assert one(text.truncated, "x" * n) == "x" * n
    assert one(text.excerpt, "é" * 5000) == "é" * 4000


def test_strip_tags(one):
    assert one(text.strip_tags, " <b>a</b> < b ", None) == ["a < b", ""]


def test_entities_without_a_semicolon(one):
    page = "<p>a&amp<b>x</b> &amp&amp &lt; &copy 1 &ampersand</p>"
    want = "a&\nx\n&& < © 1 &ampersand"
    assert one(lambda c: text.html_text(c, "named"), page) == want


def test_nested_subtrees_leave_no_text(one):
    from enrichspark.functions.text import html_text

    for mode in ("full", "named"):
        got = one(
            lambda c: html_text(c, mode),
            "a<svg><svg>x</svg>LEAK</svg>b",
            "a<template><p>x<template>y</template>z</p></template>b<svg>q</svg>c",
            "a<svg><g/><svg/>x</svg>b<svg>open<svg>",
            "a<!-- <svg><svg> -->b<script>'<svg><svg>'</script>c",
            "a<SVG w='1'>x<Svg>y</sVG>z</svg >b",
        )
        assert got == ["a\nb", "a\nb\nc", "a\nb", "a\nb\nc", "a\nb"]
