"""The ordered cost policy and its three row-level tests: predicate, gate, configuration.

A policy is a short list the user writes (a few rungs per waterfall), so its tests are built
into the plan as Columns, one per rung; no table is joined for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rung:
    waterfall: str
    ordinal: int
    rung: str
    tier: str
    invoke_when: str
    gate: str | None = None
    credits: int = 0
    usd: float = 0.0


# The default order, predicates, gates and prices.
DEFAULT_POLICY = (
    Rung("search", 1, "keyword", "free", "always"),
    Rung("search", 2, "exa", "free", "prev_rungs_empty and query.intent == 'semantic'"),
    Rung("search", 3, "tavily", "credit", "prev_rungs_empty", credits=1),
    Rung("search", 4, "parallel", "gated", "prev_rungs_empty", gate="parallel", usd=0.005),
    Rung("fetch", 1, "native", "free", "always"),
    Rung("fetch", 2, "jina", "free", "prev_rung_failed or prev.is_js_shell"),
    Rung("fetch", 3, "tavily", "credit", "prev_rung_failed", credits=1),
    Rung("fetch", 4, "parallel", "gated", "prev_rung_failed", gate="parallel", usd=0.005),
)

# Rungs that work without a key, and those that log a failed attempt when they cannot run.
KEYLESS = ("keyword", "native", "jina", "ddg")
LOGS_WHEN_UNAVAILABLE = ("tavily",)

# Names a test may use, and the context column each reads.
FLAGS = {
    "prev_rungs_empty": "prev_rungs_empty",
    "prev_rung_failed": "prev_rung_failed",
    "prev.is_js_shell": "is_js_shell",
}
OPERANDS = {
    "prev.is_js_shell": "is_js_shell",
    "query.intent": "query_intent",
    "fetched_chars": "fetched_chars",
}
_COMPARISON = re.compile(r"(?P<name>\S+?)\s*(?:==\s*'(?P<word>[^']*)'|>\s*(?P<number>\d+))")


def rungs(waterfall: str, policy: Iterable[Rung] = DEFAULT_POLICY) -> list[Rung]:
    return sorted((r for r in policy if r.waterfall == waterfall), key=lambda r: r.ordinal)


def load_policy(path: str) -> tuple[Rung, ...]:
    """A policy from a JSON list of rungs; positions give the order within a waterfall."""
    with open(path) as fh:
        rows = json.load(fh)
    return tuple(Rung(**{"ordinal": i, **row}) for i, row in enumerate(rows, 1))


def policy_frame(spark: SparkSession, policy: Iterable[Rung] = DEFAULT_POLICY) -> DataFrame:
    rows = [(r.waterfall, r.ordinal, r.rung, r.tier, r.invoke_when, r.gate, r.credits, r.usd) for r in policy]
    return spark.createDataFrame(
        rows,
        "waterfall string, ordinal int, rung string, tier string, invoke_when string, "
        "gate string, credits int, usd double",
    )


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _test(text: str, ctx: Mapping[str, Column]) -> Column | None:
    """One test as a Column; None where the text is not understood."""
    if text == "always":
        return F.lit(True)
    if text in FLAGS:
        return _truth(ctx.get(FLAGS[text], F.lit(False)))
    found = _COMPARISON.fullmatch(text)
    if not found or found["name"] not in OPERANDS:
        return None
    operand = OPERANDS[found["name"]]
    if found["number"] is not None:
        number = ctx.get(operand, F.lit(0)).try_cast("double")
        return F.coalesce(number, F.lit(0.0)) > float(found["number"])
    # Only the intent is a text; a flag or a count never equals a quoted word.
    if operand != "query_intent":
        return F.lit(False)
    return _truth(ctx.get(operand, F.lit(None).cast("string")) == found["word"])


def policy_col(invoke_when: str | None, ctx: Mapping[str, Column]) -> Column:
    """Whether a rung fires. Branches are read in order: a branch with an unknown test closes
    the rung for every row that no earlier branch has let through."""
    fires = F.lit(False)
    for branch in re.split(r"\s+or\s+", (invoke_when or "").strip()):
        tests = [_test(a.strip(), ctx) for a in re.split(r"\s+and\s+", branch)]
        if any(t is None for t in tests):
            break
        held = F.lit(True)
        for t in tests:
            held = held & t
        fires = fires | held
    return fires


def gate_col(rung: Rung, allowed: Mapping[str, Column], user_invocation: Column | None = None) -> Column:
    """Whether a gated rung is cleared. The ``parallel`` clearance opens every gate."""
    if not rung.gate:
        return F.lit(True)
    cleared = _truth(allowed.get("parallel", F.lit(False)))
    cleared = cleared | _truth(allowed.get(rung.gate, F.lit(False)))
    return cleared | _truth(user_invocation) if user_invocation is not None else cleared


def is_configured(rung: str, configured: Iterable[str]) -> bool:
    return rung in KEYLESS or rung in set(configured)


def configured_rungs(policy: Iterable[Rung], configured: Iterable[str]) -> list[Rung]:
    keys = set(configured)
    return [r for r in policy if is_configured(r.rung, keys)]


def configured_col(provider: Column, configured: Iterable[str]) -> Column:
    return provider.isin(*KEYLESS, *configured)
