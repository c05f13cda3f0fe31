import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from enrichspark.llm import chat

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
U, A = "user", "assistant"
RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": U, "content": "q"}]}, "messages", [("system", "s"), (U, "q")]),
    ({"messages": [{"content": "q", "role": None}, {"content": None, "role": A}]}, "messages", [("", "q"), (A, "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "sharegpt", [(U, "q"), (A, "a"), ("tool", "t")]),
    ({"system": "s", "messages": [{"role": U, "content": "q"}]}, "system_messages", [("system", "s"), (U, "q")]),
    ({"prompt": "p", "response": "r"}, "prompt", [(U, "p"), (A, "r")]),
    ({"completion": "c", "prompt": None}, "completion", [(U, ""), (A, "c")]),
    ({"question": "q", "answer": "a"}, "question", [(U, "q"), (A, "a")]),
    ({"instruction": "i", "output": "o"}, "instruction", [(U, "i"), (A, "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [(U, "i\nx"), (A, "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [(U, "i"), (A, "o")]),
    ({"prompt": "p", "other": "r"}, None, None),
    ({"messages": "text"}, None, None),
    ([1, 2], None, None),
    ("just text", None, None),
]


def canonical(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "n int, record string, turns string")
    return [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).orderBy("n").collect()]


def test_layouts(spark):
    got = canonical(spark, [json.dumps(r) for r, _, _ in RECORDS])
    assert got == [(layout, turns) for _, layout, turns in RECORDS]


def test_no_json(spark):
    assert canonical(spark, [None, "", "{", "nul"]) == [(None, None)] * 4


def paths(value, at=""):
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def test_fingerprint_is_the_hash_of_field_paths(spark):
    values = [r for r, _, _ in RECORDS if isinstance(r, dict)] + [
        {"a": {"b": [{"c": [1, 2], "d": {"e": True}}, {"f": 1.5}], "g": "x"}, "odd name": None, "x:y": [["z"]]}
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "n int, record string")
    got = [r.fingerprint for r in chat.with_fingerprint(df, "record").orderBy("n").collect()]
    assert got == [hashlib.sha256("\n".join(sorted(paths(v))).encode()).hexdigest() for v in values]


NASTY = [
    "", " ", "\n", "\\", "\\\\", "\\b", "\\h\\l\\c", "#", "###", "### user: hi</turn>\n", "</turn>\n", "</turn>", ": ", "a: b", chat.PROBE,
    "\\### Assistant: </turn> ok\\", "é\U0001f600\u2028x", "\\\\### \\\\\\", "<\\l:\\c", "\t\r\n\x00end", "x" * 100_000,
]


def test_round_trip(spark):
    turns = [(r, t) for r in (U, A, "a: b\n### x</turn>\n", "", "\\") for t in NASTY]
    df = spark.createDataFrame([([{"role": r, "text": t} for r, t in turns],)], "turns array<struct<role:string,text:string>>")
    df = df.select("turns", chat.formatted(F.col("turns")).alias("f"), chat.loss_mask(F.col("turns")).alias("m"))
    row = df.select("*", chat.parsed(F.col("f")).alias("back"), chat.under_loss(F.col("f"), F.col("m")).alias("loss")).first()
    assert [tuple(t) for t in row.back] == turns
    assert "".join(row.loss) == "".join(t for r, t in turns if r == A)
    assert sum(p.before + p.under + p.after for p in row.m) == len(row.f)
    at, masked = 0, []
    for p in row.m:
        masked.append(row.f[at + p.before : at + p.before + p.under])
        at += p.before + p.under + p.after
    assert row.f.count("</turn>\n") == len(turns) and all("<" not in m and "#" not in m for m in masked)


def plain_query(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn if turn is not None else -(1 << 62), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == A)
        esc = lambda s: s.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l").replace(":", "\\c")
        text = "".join(f"### {esc(r)}: {esc(t)}</turn>\n" for _, r, t in turns)
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(text))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_query_equals_plain_python(spark, extra):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    if extra:
        rows = [
            (900, 0, U, "q"), (900, 1, A, None), (901, 0, "human", "x"), (901, 1, "gpt", "y"), (902, None, None, "z"), (902, 0, A, "b"), (902, 0, A, "a"),
            (903, 0, A, "only"), (903, 0, A, "only"), (None, 1, U, "w"), (904, 5, U, "\\### x"), (904, 6, A, "</turn>\n"), (906, 1, A, ""),
        ]
        df = df.unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).selectExpr("*", "1 as record", "2 as t")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()] + [(-7, 0, U, chat.PROBE), (-7, 1, A, chat.PROBE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.op2_chat_formatting(df).collect()}
    assert got == plain_query(rows)


def test_empty_table_gives_the_probe(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.op2_chat_formatting(df).collect()] == [-7]


def test_no_python_in_the_plan(spark):
    plan = chat.op2_chat_formatting(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
