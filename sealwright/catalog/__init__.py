"""Registered queries: each operator over whole tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.fixtures import Fixtures, duckdb_text


@dataclass(frozen=True)
class Entry:
    run: Callable[[Fixtures], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures under an operator's name."""

    def wrap(run: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return wrap


def _load() -> None:
    from . import (  # noqa: F401
        configuration, coverage, graph, inventory, links, records, release, snapshots, stages, symbols,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return entry.run(Fixtures(spark, folder))

        return run

    return {name: bind(entry) for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: duckdb_text(entry.sql) for name, entry in REGISTRY.items() if entry.sql is not None}
