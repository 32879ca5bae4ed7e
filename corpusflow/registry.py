"""The library's own queries, each with the same in SQL where SQL can express it."""

from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
