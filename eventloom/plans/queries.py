"""All registered queries of the event engine."""

from __future__ import annotations

from . import analytic, dashboards, linking, listing, lookups, relational, series, sourced, streams, texts  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
