"""All queries of the text operators."""

from tidemark.llm import queries  # noqa: F401  (they register on import)
from tidemark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
