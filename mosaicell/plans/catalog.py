"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from . import annotation_queries, cell_queries, image_queries  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
