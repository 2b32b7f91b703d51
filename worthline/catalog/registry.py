"""Registry that keeps a query and its checking SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worthline.plans.entities import ENTITIES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function; ``sql`` may read the view ``entities``."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = on_entities(sql)
        return function

    return register


def on_entities(sql: str) -> str:
    body = sql.strip()
    if "entities" not in body:
        return body
    if body[:5].lower() == "with ":
        return f"with {ENTITIES_SQL}, {body[5:]}"
    return f"with {ENTITIES_SQL} {body}"


def r(c: str | Column, places: int = 4) -> Column:
    """Rounded for comparison; adding zero removes a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)
