"""Token counts beside the library on whole texts, and what the cache spares."""

import os
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from enrichspark.llm import tokens

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = tokens.load(PATH, words=True)
SCHEMA = "doc_id long, text string"

ODD = [
    None, "", " ", "\t\n\x0b\f\r ", "a", "A a  A", "it's  we'LL 'd 've", "<|endoftext|>", "x<|startoftext|>y z", "<|ENDOFTEXT|> <|endof text|>",
    "é ́e é É", "a b c　d\u0085e f᠎g​h\x1ci\x1fj", "中文字 テスト 한국어", "🙂🙂 👩‍👩‍👧", "İstanbul ǅ ẞ ﬁ",
    "x" * 20000, "word " * 30000, "1234567890 3.14", "a b c", "﻿bom \x00nul", "don't’s",
]


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "\n", "<|endoftext|>", "́", "'s", " ", "A"])), max_size=12))
def test_words_add_up(parts):
    text = "".join(parts)
    assert WORDS.counter()([text]) == [plain(text)]


def test_equals_the_library(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, len((r.text or "").encode()), plain(r.text), plain(r.text) > 2048) for r in docs.collect())
    got = tokens.op11_token_counts(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == want and any(w[3] for w in want)


def test_odd_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again"), (7, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "1 as n_tokens", "2 as id", "3 as `a.b`", "text as content")
    want = sorted(((i, len((t or "").encode()), plain(t)) for i, t in rows), key=repr)
    for n, tokenizer in enumerate((WORDS, tokens.load(PATH))):
        got = tokens.count_tokens(docs, tokenizer, str(tmp_path / str(n))).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert tokens.count_tokens(docs.limit(0), WORDS, str(tmp_path / "none")).count() == 0


def test_other_library(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Some  text."), (2, None), (3, "\n")], SCHEMA)
    got = {r.id: r.n_tokens for r in tokens.count_tokens(docs, tokens.load(path), str(tmp_path)).collect()}
    assert got == {i: len(model.encode(t)) for i, t in ((1, "Some  text."), (2, ""), (3, "\n"))}


def held(spark, cache, tokenizer):
    return spark.read.schema(tokens.COUNTS).parquet(f"{cache}/version={tokenizer.version}")


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_only_distinct_misses_are_encoded(spark, tmp_path, broadcast_rows):
    cache = str(tmp_path / "cache")
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(9))) for _ in range(40)]
    first = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["hot copy"] * 500 + [" hot  copy\n"] * 20)], SCHEMA).repartition(7)
    second = spark.createDataFrame([(i, t) for i, t in enumerate(["new one", *texts, "new one", "new two"])], SCHEMA)

    def run(docs, tokenizer=WORDS):
        got = sorted(map(tuple, tokens.count_tokens(docs, tokenizer, cache, broadcast_rows=broadcast_rows).collect()))
        assert got == sorted((r.doc_id, len(r.text.encode()), plain(r.text)) for r in docs.collect())
        return held(spark, cache, tokenizer).count()

    distinct = len({" ".join(t.split()) for t in texts} | {"hot copy"})
    assert run(first) == distinct
    assert run(first) == distinct  # nothing new
    assert run(second) == distinct + 2
    whole = tokens.load(PATH)  # another version knows nothing of it
    assert whole.version != WORDS.version and run(second, whole) == len({*texts, "new one", "new two"})
    assert held(spark, cache, WORDS).count() == distinct + 2


def test_counts_come_from_the_cache(spark, tmp_path):
    """What jobs side by side appended twice counts once; a stored count is taken as it is."""
    cache = str(tmp_path)
    docs = spark.createDataFrame([(1, "seen before"), (2, "unseen")], SCHEMA)
    tokens.count_tokens(docs.filter("doc_id = 1"), WORDS, cache).collect()
    known = held(spark, cache, WORDS).selectExpr("digest", "cast(77 as long) as n_tokens").collect()
    spark.createDataFrame(known * 2, tokens.COUNTS).write.mode("append").parquet(f"{cache}/version={WORDS.version}")
    got = sorted((r.id, r.n_tokens) for r in tokens.count_tokens(docs, WORDS, cache).collect())
    assert got == [(1, 77), (2, plain("unseen"))]
