"""All queries of the library with their oracle SQL, by name."""

from __future__ import annotations

from touchline.plans.oracle import ORACLE_SQL
from touchline.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
