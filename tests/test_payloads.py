import json

from pyspark.sql import functions as F

from enrichspark.functions import payloads as P


def plain(results):
    return [(r["title"], r["url"], r["content"]) for r in results]


def read(one, reader, doc):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return plain(one(reader, text))


LITE = """<table><tr><td><a rel="nofollow" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.com%2Fa%2Bb+c&amp;rut=1" class='result-link'><b>Ac</b>me</a></td></tr>
<td class='result-snippet' x="1">About
<b>Acme</b></td>
<a rel="nofollow" href="https://b.com/" class='result-link'>B</a>"""


def test_lite_html(one):
    page = lambda c: P.lite_html(c, F.lit(200))
    assert read(one, page, LITE) == [("Acme", "https://acme.com/a+b+c", "About\nAcme"), ("B", "https://b.com/", "")]
    assert read(one, page, LITE + "Challenge-Form") == []
    assert read(one, lambda c: P.lite_html(c, F.lit(202)), LITE) == []
    assert read(one, lambda c: P.lite_html(c, F.lit(200), 1), LITE) == [("Acme", "https://acme.com/a+b+c", "About\nAcme")]
    assert read(one, page, "") == []


def test_json_shapes(one):
    web = {"web": {"results": [{"title": "T", "url": "u", "description": " <b>d</b> "}, {"url": "v"}]}}
    assert read(one, P.web_results, web) == [("T", "u", "d"), ("", "v", "")]
    assert read(one, P.web_results, {"web": None}) == []
    organic = {"organic": [{"title": "T", "link": "u", "snippet": "s"}], "other": 1}
    assert read(one, P.organic, organic) == [("T", "u", "s")]
    assert read(one, P.organic, "not json") == []
    assert read(one, P.organic, {}) == []
    assert read(one, lambda c: P.plain(c, 1), {"results": [{"title": "a"}, {"title": "b"}]}) == [("a", "", "")]


def test_text_or_snippet(one):
    doc = {"results": [{"title": "a", "url": "u", "text": "x" * 700, "snippet": "s"}, {"text": "", "snippet": "s"}, {}]}
    got = read(one, P.text_or_snippet, doc)
    assert [r[2] for r in got] == ["x" * 600, "s", ""]


def test_excerpts(one):
    doc = {
        "results": [
            {"excerpts": ["a", "b"], "content": "c"},
            {"excerpts": [], "excerpt": "e"},
            {"excerpts": "one text"},
            {"content": "[not a list"},
            {},
        ]
    }
    assert [r[2] for r in read(one, P.excerpts, doc)] == ["a b", "e", "one text", "[not a list", ""]


def test_embedded_array(one):
    array = '[{"title": "a", "url": "u", "snippet": "s"}, "noise", 3, {"title": "b"}]'
    want = [("a", "u", "s"), ("b", "", "")]
    assert read(one, P.embedded_array, f"Sure!\n{array}\nBye") == want
    assert read(one, P.embedded_array, {"type": "x", "result": f"Sure: {array}"}) == want
    assert read(one, P.embedded_array, "none") == []
    assert read(one, P.embedded_array, "[broken") == []
    assert read(one, P.embedded_array, "[1, 2") == []


def test_extract_body(one):
    assert one(P.extract_body, json.dumps({"results": [{"excerpts": ["a", "b"]}]})) == "a\n\nb"
    assert one(P.extract_body, json.dumps({"results": [], "extracts": [{"content": "c"}]})) == "c"
    assert one(P.extract_body, json.dumps({"extracts": [{"markdown": "m"}, {"content": "x"}]})) == "m"
    assert one(P.extract_body, json.dumps({})) == ""
    assert one(lambda c: P.extract_body_ok(c), "x" * 200, " " + "x" * 199) == [True, False]


def test_raw_content(one):
    doc = {"results": [{"url": "u", "raw_content": "r"}, {"url": "v"}, {"url": "", "raw_content": "x"}]}
    assert [(r["url"], r["raw_content"]) for r in one(P.raw_content_pairs, json.dumps(doc))] == [("u", "r")]


def test_one_reader_for_all_providers(rows):
    df = rows(
        [
            ("serper", json.dumps({"organic": [{"title": "s"}]}), 200),
            ("brave", json.dumps({"web": {"results": [{"title": "b"}]}}), 200),
            ("claude_cli", '[{"title": "c"}]', 200),
            ("exa", json.dumps({"results": [{"title": "e"}]}), 200),
            ("exa", json.dumps({"results": [{"title": "e"}]}), 500),
            ("tavily", "oops", 200),
            ("unknown", "{}", 200),
            ("ddg", LITE, 200),
        ],
        "provider string, payload string, status int",
    )
    got = df.select(P.read_payload(F.col("provider"), F.col("payload"), F.col("status"))).collect()
    assert [[r["title"] for r in row[0]] for row in got] == [["s"], ["b"], ["c"], ["e"], [], [], [], ["Acme", "B"]]
