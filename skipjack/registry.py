"""Queries of the engine and their DuckDB forms, by name."""

from __future__ import annotations

from skipjack.plans import more_queries  # noqa: F401  (registers its queries)
from skipjack.plans.queries import ORACLES, QUERIES  # noqa: F401
