"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from tessera.plans import clusters, extras, graphs, profiles, raw, recommendations, streams  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
