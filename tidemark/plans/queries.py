"""Registered queries over the Parquet tables and their SQL twins."""

from __future__ import annotations

from tidemark.plans import alignment, charts, entities, gates, presentation, recognition, reports, series  # noqa: F401  (they register their queries)
from tidemark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
