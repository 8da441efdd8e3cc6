"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import boost_queries, boost_sql, catalog, counter_queries, coverage_queries, keyed_queries, model_queries, scoring_queries, source_queries, stored_queries, stream_queries, summary_queries, truth_queries  # noqa: F401 - registration side effects
from .catalog import QUERIES
from .oracle import SQL

__all__ = ["QUERIES", "SQL"]
