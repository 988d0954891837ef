"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from .plans.catalogue import ORACLE_SQL, QUERIES

FLAGSHIP = "point_metrics"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
