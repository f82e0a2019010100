"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import registry
from .plans import costs, experiments, files, graphs, measures, memories, retrieval, runs, star, states, stores, streams, texts, workloads  # noqa: F401  they register queries
from .registry import Query


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
