"""All registered queries."""

from __future__ import annotations

from lodestone.plans import changes, checks, code, conversations, facts, graphs, indexes, joins, lookups, memory, overlays, scores, searches, sources, streams, tables, telemetry  # noqa: F401
from lodestone.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
