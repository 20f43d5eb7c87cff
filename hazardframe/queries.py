"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from hazardframe.plans import basic, forests, models, scoring, streams  # noqa: F401
from hazardframe.plans.registry import ORACLES, QUERIES

flagship = QUERIES["aalen_johansen"]

__all__ = ["ORACLES", "QUERIES", "flagship"]
