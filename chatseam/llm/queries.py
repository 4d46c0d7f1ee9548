"""Importing this module registers every query of the package."""

from chatseam.llm import alignment, line_dedup, mixing, neighbours, packing, pieces, pii, quality, sharding, simhash, suffixes, tries, urls  # noqa: F401
from chatseam.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
