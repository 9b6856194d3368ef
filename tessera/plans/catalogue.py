"""All queries over the reference's own operators."""

from __future__ import annotations

from tessera.plans import pipeline_queries, row_queries, text_queries, training_queries  # noqa: F401  (they register themselves)
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
