"""All registered queries and their oracles."""

from __future__ import annotations

from facetspark.plans import composed_queries, descriptor_queries, learning_queries, surface_queries  # noqa: F401  they register
from facetspark.plans.catalogue import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
