"""Registration of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioweave.operators import views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name; `sql` follows the shared views, which it may extend with ', x AS (...)'."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{W.VIEWS_SQL.strip()} {sql}") if views else sql
        return f

    return register
