"""Queries over the driver's tables, and their SQL."""

from lodestar.plans import measure, sampling, search, structure, texts
from lodestar.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "measure", "sampling", "search", "structure", "texts"]
