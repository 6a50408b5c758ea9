"""Operators of a training-data pipeline; nothing else in the library imports them."""

from .queries import queries
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
