"""All registered queries and the SQL that each must equal."""

from __future__ import annotations

from . import analytics, relational  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
