"""Line scan for keys, home paths and other texts that must not leave, with a closed verdict."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import bind


@dataclass(frozen=True)
class ScanRule:
    name: str
    check: str
    pattern: str
    allowed: str | None = None
    any_case: bool = True
    # Lower-case texts of which any match holds at least one; a cheap test ahead of the pattern.
    literals: tuple[str, ...] = ()

    def regex(self) -> str:
        # Only a line feed ends a line.
        return f"(?{'i' if self.any_case else ''}d){self.pattern}"


_KEY_NAMES = ("api_key", "apikey", "token", "secret", "password", "bearer")
_NETWORK_LITERALS = ("gh api ", "gh api", "contents/.env")
DEFAULT_RULES = (
    ScanRule("private_key", "secret", C.PRIVATE_KEY_RULE, literals=("private key",)),
    ScanRule("secret", "secret", C.SECRET_RULE, C.SECRET_ALLOWED, any_case=False, literals=_KEY_NAMES),
    ScanRule("home_path", "home_path", C.HOME_PATH_RULE, literals=("/users/",)),
    *(
        ScanRule(f"network_key_{i}", "network_key", pattern, literals=(literal,))
        for i, (pattern, literal) in enumerate(zip(C.NETWORK_KEY_RULES, _NETWORK_LITERALS, strict=True), 1)
    ),
)
# Wider than the default: key names in any case.
SECRET_ANY_CASE = ScanRule("secret_any_case", "secret", C.SECRET_RULE, C.SECRET_ALLOWED, literals=_KEY_NAMES)


def deny_terms(*patterns: str) -> tuple[ScanRule, ...]:
    """Private terms as rules; a pattern of plain ASCII words is its own literal."""

    def literals(pattern: str) -> tuple[str, ...]:
        return (pattern.lower(),) if re.fullmatch(r"[A-Za-z0-9_ ]+", pattern) else ()

    return tuple(ScanRule(f"deny_{i}", "private_terms", p, literals=literals(p)) for i, p in enumerate(patterns, 1))


def leak_scan(
    df: DataFrame, rules: Sequence[ScanRule] = DEFAULT_RULES, key: str = "doc_id", col: str = "text"
) -> DataFrame:
    """One row per (document, line, rule) found.

    Patterns are tried on lines only, so anchors mean line ends everywhere. Texts that hold none of
    the rules' literals are dropped before lines are exploded, unless a rule has no literal. The
    allow-list is read against the line alone.
    """

    def holds(rule: ScanRule, low: Column) -> Column:
        return reduce(or_, (F.contains(low, F.lit(t)) for t in rule.literals)) if rule.literals else F.lit(True)

    texts = df.select(key, col)
    if all(rule.literals for rule in rules):
        texts = texts.where(bind(F.lower(col), lambda low: reduce(or_, (holds(r, low) for r in rules))))
    lines = (
        texts
        .select(key, F.posexplode(F.split(col, "\n")).alias("_i", "line"))
        .withColumn("line_no", (F.col("_i") + 1).cast("long"))
    )

    def found(rule: ScanRule, low: Column) -> Column:
        hit = holds(rule, low) & F.col("line").rlike(rule.regex())
        if rule.allowed:
            hit = hit & ~F.col("line").rlike(f"(?i){rule.allowed}")
        return F.when(hit, F.lit(rule.name))

    hits = bind(F.lower("line"), lambda low: F.array_compact(F.array(*[found(r, low) for r in rules])))
    return lines.select(key, "line_no", F.explode(hits).alias("rule"), "line")


def leak_verdict(findings: DataFrame, rules: Sequence[ScanRule] = DEFAULT_RULES) -> DataFrame:
    """Every check with its findings and verdict, and an ``overall`` row that passes only if all do."""
    spark = findings.sparkSession
    checks = spark.createDataFrame([(r.check, r.name) for r in rules], "check string, rule string")
    counts = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum(F.coalesce("_n", F.lit(0)))
    per_check = checks.join(counts, "rule", "left").rollup("check").agg(
        F.grouping("check").alias("_all"), total.alias("findings")
    )
    name = F.when(F.col("_all") == 1, "overall").otherwise(F.col("check"))
    return per_check.select(name.alias("check"), "findings", (F.col("findings") == 0).alias("passed"))
