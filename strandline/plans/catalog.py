"""All registered queries of the analytics engine."""

from __future__ import annotations

from strandline.plans import adaptiveplan, cellgraphs, cellstates, cohort, effects, events, linking, potency, regions, reports, sequences, simulation, variable  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
