"""All registered queries of the time-series operators, with their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that DuckDB answers alike."""

    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    """Importing the modules of queries registers them."""
    for module in ("features", "relations", "rules", "statistics", "micro", "prices", "lookups", "reports", "landing", "trials", "depth", "guarded", "nested", "books", "lifecycle", "controls", "normalised"):
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
