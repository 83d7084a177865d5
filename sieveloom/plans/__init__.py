"""The queries over the test tables, by operator id, and SQL that gives the same rows."""

from sieveloom.plans import analytics, io, relational, scalar, statistics  # noqa: F401
from sieveloom.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
