"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "JN7_mirror_match"
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory name, with its SQL twin where one exists."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


MODULES = ("matching", "geometry", "graphs", "scoring", "clusters", "images", "faces", "drivers", "layouts")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"vecmosaic.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
