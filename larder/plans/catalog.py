"""All registered queries."""

from larder.plans import part_queries, queries, record_queries, stream_queries  # noqa: F401  (importing them registers them)
from larder.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
