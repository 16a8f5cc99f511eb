"""Registry of queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

MODULES = (
    "selection",
    "tables",
    "preparation",
    "text_features",
    "sampling",
    "configurations",
    "utilities",
    "rankings",
    "reports",
    "statistics",
    "models",
    "rules",
    "streams",
)


def query(name: str, oracle: str | None = None):
    """Register a function (spark, folder) -> DataFrame under ``name``."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise KeyError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def _load() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"siftwork.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"siftwork.plans.{m}":
                raise


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
