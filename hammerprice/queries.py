"""Named queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

from .plans import backlog, batches, dimensions, intents, market, merges, operations, panels, prices, series, streams, texts, titles, valuations  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
