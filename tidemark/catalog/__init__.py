"""The registered queries of the library, by name, and SQL for those that SQL can express."""

from . import analysis, base, features, research, scans, tables, validity
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "base", "features", "research", "scans", "tables", "validity"]
