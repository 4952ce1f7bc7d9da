"""The registered queries of the analytics engine and their DuckDB equivalents."""

from __future__ import annotations

from provenant.plans import actors, bridges, dataset, discussion, evidence, features, groups, ownership, participants, payloads, reports, summaries  # noqa: F401  they register their queries
from provenant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
