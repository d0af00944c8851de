"""All registered queries."""

from tidemark.plans import (  # noqa: F401  (they register on import)
    queries_documents, queries_facts, queries_portfolio, queries_prices, queries_sources,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
