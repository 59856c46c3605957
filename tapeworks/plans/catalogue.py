"""All queries of the engine by name, and the SQL that gives the same rows."""

from .oracle import ORACLE
from .queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
