import json

import pytest
from pyspark.sql import functions as F

from enrichspark.functions import policy as P


def fires(spark, expr, **ctx):
    cols = {k: F.lit(v) for k, v in ctx.items()}
    return spark.range(1).select(P.policy_col(expr, cols)).first()[0]


def cleared(spark, rung, user=None, **allowed):
    cols = {k: F.lit(v) for k, v in allowed.items()}
    return spark.range(1).select(P.gate_col(rung, cols, None if user is None else F.lit(user))).first()[0]


def rung(waterfall, name):
    return next(r for r in P.rungs(waterfall) if r.rung == name)


def test_default_order():
    assert [r.rung for r in P.rungs("search")] == ["keyword", "exa", "tavily", "parallel"]
    assert [r.rung for r in P.rungs("fetch")] == ["native", "jina", "tavily", "parallel"]


def test_published_truth_table(spark):
    exa, jina, par = rung("search", "exa"), rung("fetch", "jina"), rung("search", "parallel")
    assert not fires(spark, exa.invoke_when, prev_rungs_empty=True, query_intent="keyword")
    assert fires(spark, exa.invoke_when, prev_rungs_empty=True, query_intent="semantic")
    assert fires(spark, jina.invoke_when, prev_rung_failed=False, is_js_shell=True)
    assert not cleared(spark, par)
    assert cleared(spark, par, parallel=True)
    assert not P.is_configured("exa", []) and not P.is_configured("parallel", [])
    assert P.is_configured("jina", [])


CASES = [
    ("", {}, False),
    (None, {}, False),
    ("always", {}, True),
    ("always or bogus", {}, True),
    ("bogus or always", {}, False),
    ("prev_rung_failed or bogus", {"prev_rung_failed": False}, False),
    ("always and bogus", {}, False),
    ("prev_rungs_empty", {}, False),
    ("is_js_shell", {"is_js_shell": True}, False),
    ("prev.is_js_shell", {"is_js_shell": True}, True),
    ("query.intent == 'semantic'", {"query_intent": None}, False),
    ("query.intent=='semantic'", {"query_intent": "semantic"}, True),
    ("fetched_chars > 8000", {"fetched_chars": 8001}, True),
    ("fetched_chars > 8000", {"fetched_chars": 8000}, False),
    ("fetched_chars > 8000", {}, False),
    ("query.intent > 3", {"query_intent": "five"}, False),
    ("query.intent > 3", {"query_intent": "5"}, True),
    ("fetched_chars == '9'", {"fetched_chars": 9}, False),
    ("not always", {}, False),
    ("(always)", {}, False),
    ("prev_rung_failed and prev.is_js_shell or always", {"prev_rung_failed": True}, True),
]


@pytest.mark.parametrize(("expr", "ctx", "want"), CASES)
def test_predicate(spark, expr, ctx, want):
    cols = {k: F.lit(v).cast("string") if v is None else F.lit(v) for k, v in ctx.items()}
    assert spark.range(1).select(P.policy_col(expr, cols)).first()[0] is want


def test_unknown_branch_closes_only_rows_still_open(spark, rows):
    df = rows([(True,), (False,)], "f boolean")
    got = df.select(P.policy_col("prev_rung_failed or bogus or always", {"prev_rung_failed": F.col("f")})).collect()
    assert [r[0] for r in got] == [True, False]


def test_gates(spark):
    other = P.Rung("fetch", 9, "vault", "gated", "always", gate="vault")
    assert not cleared(spark, other)
    assert cleared(spark, other, vault=True)
    assert cleared(spark, other, parallel=True)
    assert cleared(spark, other, user=True)
    assert cleared(spark, rung("fetch", "native"))


def test_policy_file(tmp_path, spark):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps([{"waterfall": "fetch", "rung": "native", "tier": "free", "invoke_when": "always"}]))
    loaded = P.load_policy(str(path))
    assert loaded[0].ordinal == 1
    assert P.policy_frame(spark, loaded).count() == 1
    assert [r.rung for r in P.configured_rungs(P.rungs("search"), ["exa"])] == ["keyword", "exa"]
