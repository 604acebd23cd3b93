"""Every query of the engine by name, and its SQL form."""

from __future__ import annotations

from quillon.plans import deep_queries, planning_queries, quality_queries, registry, render_queries, report_queries, search_queries, spatial_queries, state_queries, statistics_queries, streaming_queries, synthetic_queries, world_queries

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES

__all__ = ["ORACLES", "QUERIES", "deep_queries", "planning_queries", "quality_queries", "render_queries", "report_queries", "search_queries", "spatial_queries", "state_queries", "statistics_queries", "streaming_queries", "synthetic_queries", "world_queries"]
