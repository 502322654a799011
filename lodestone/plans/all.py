"""All registered queries of the reference's operators."""

from lodestone.plans import analytics, functions, graph, inquiry, relational, search, sources  # noqa: F401
from lodestone.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
