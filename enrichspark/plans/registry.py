"""Named queries with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from enrichspark.plans import oracle
from enrichspark.sources.derived import Derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] | str = ()):
    """Register a query over the derived tables; ``needs`` names the SQL tables its check uses."""
    tables = needs.split() if isinstance(needs, str) else needs

    def register(build: Callable[[Derived], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Derived(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle.sql(sql, *tables)
        return build

    return register
