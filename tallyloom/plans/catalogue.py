"""All queries of the engine's own operators."""

from __future__ import annotations

from tallyloom.plans import cost_queries, file_queries, forecast_queries, quality_queries, rate_queries, reconcile_queries, screen_queries, source_queries, usage_queries  # noqa: F401  registers its queries
from tallyloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
