"""Records beyond the limits of JSON readers."""

import json

import pytest
from pyspark.sql import functions as F

from enrichspark.llm import chat
from test_llm_chat import RECORDS, canonical


def test_text_of_21_million_characters(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit('a"\\\n{'), 4_200_000)).otherwise(F.col("text")))
    got = {r.conv_id: r for r in chat.op2_chat_formatting(df).collect()}[1]
    assert (got.n_turns, got.loss_chars) == (3, 21_000_000)


def test_outline_keeps_layouts(spark, monkeypatch):
    """All records read as long ones: the same layouts, and no JSON stays no JSON."""
    monkeypatch.setattr(chat, "LONG", 0)
    odd = {"messages": [{"role": 'r"\\', "content": '\\"{},[]: é\n' * 50}] * 3}
    got = canonical(spark, [json.dumps(r) for r, layout, _ in RECORDS if layout] + [json.dumps(odd)])
    assert got[:-1] == [(layout, turns) for _, layout, turns in RECORDS if layout]
    assert got[-1] == ("messages", [(m["role"], m["content"]) for m in odd["messages"]])
    df = spark.createDataFrame([(r,) for r in ('{"prompt": "a\\q", "response": "b"}', '{"prompt": "a\nb", "response": "c"}')], "r string")
    monkeypatch.setattr(chat, "LONG", 10)
    short = [r[0] for r in df.select(F.regexp_replace("r", F.lit(chat.BLANK), F.lit("$1$2$3"))).collect()]
    assert '"a\\q' in short[0] and '"a\nb' in short[1]


def test_a_long_record_that_cannot_be_read_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "LONG", 5)
    with pytest.raises(Exception, match="cannot be read|too large"):
        canonical(spark, ['{"messages": ["a", "b"]}'])
