"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelflight.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL twin where there is one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"shelflight.registry.{module}")


MODULES = ["cleaning", "reporting", "activity", "texts", "recommending", "streams"]
