"""End-to-end runs and the queries registered for checking."""

from chatseam.plans import analysis_queries, ingest_queries  # noqa: F401
from chatseam.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
