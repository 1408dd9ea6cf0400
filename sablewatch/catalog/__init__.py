"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _family in (
    "ingest", "detections", "contracts", "enrichment", "triage", "analytics", "memory", "streams",
):
    import_module(f"{__name__}.{_family}")

__all__ = ["ORACLES", "QUERIES"]
