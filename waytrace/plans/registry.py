"""Names, DataFrame builders and DuckDB texts of the registered queries."""

from __future__ import annotations

from waytrace.plans import exchange
from waytrace.plans.telemetry import ORACLES, QUERIES

FLAGSHIP = "road_match_merged"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "exchange"]
