"""Every operator as a query over the given tables, next to the SQL that says the same.

Importing the modules below fills QUERIES and SQL.
"""

from .registry import QUERIES, SQL
from . import aggregates, joins, pages, rules, scalars, scans, streams, tables, versions  # noqa: F401

__all__ = ["QUERIES", "SQL"]
