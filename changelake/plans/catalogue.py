"""All core queries and their oracle SQL by name."""

from __future__ import annotations

from changelake.plans import batches, events, health, reliability, sinks, streams  # noqa: F401  they register themselves
from changelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
