"""All queries by name, and their SQL."""

from fringework.queries import catalogue  # noqa: F401
from fringework.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
