"""The registry of named queries: each binds an operator to views, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeworks.plans.bindings import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named views; ``sql`` is DuckDB SQL over the same views."""
    names = views.split()

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, v) for v in names])
        if sql is not None:
            ORACLES[name] = with_views(names, sql)
        return build

    return add
