"""Every registered query beside its SQL twin on the given tables."""

import ast
import inspect

import check
import pytest

import __spark_entry__ as entry
from conftest import SF
from enrichspark.plans import catalog

BATCH = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", BATCH)
def test_query_equals_its_sql(spark, con, name):
    verdict, note = check.compare(spark, con, name, SF)
    assert verdict in ("ok", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_no_query_collects():
    """No registered query or operator pulls rows to the driver."""
    import pathlib

    root = pathlib.Path(inspect.getfile(entry)).parent / "enrichspark"
    banned = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "crossJoin"}
    for path in root.rglob("*.py"):
        if path.parent.name == "llm":  # models are fitted from bounded samples there
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                assert node.func.attr not in banned, f"{path}: {node.func.attr}"
