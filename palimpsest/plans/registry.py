"""Every query of the engine's own operators, with its oracle."""

from __future__ import annotations

from palimpsest.plans.queries import ORACLES, QUERIES, technique_counts

#: The flagship: observations derived from documents, through all detectors, counted.
FLAGSHIP = technique_counts

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
