"""Registered queries over the given tables, each with the SQL that it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its SQL if there is any."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def load_all() -> None:
    from starfold.queries import corpus, definitions, functions, inference, joins, measures, projections, visuals  # noqa: F401
