"""Registered queries of the retrieval and analytics operators, with their SQL twins."""

from . import analytics, dialogue, language, search, sweeps
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "dialogue", "language", "search", "sweeps"]
