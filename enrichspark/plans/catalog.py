"""All registered queries; importing the modules fills the registry."""

from enrichspark.plans import (  # noqa: F401
    payload_queries,
    report_queries,
    resolve_queries,
    stream_queries,
    table_queries,
)
from enrichspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
