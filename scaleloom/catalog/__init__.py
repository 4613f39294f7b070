"""Registered queries over the test tables, with the SQL they are held against."""

from . import entities, signals, surfaces  # noqa: F401  they register their queries
from .common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
