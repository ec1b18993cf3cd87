"""How a module of plans collects its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): the decorator takes a query's SQL, or None, and names the query by its function."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def money(c: str) -> Column:
    """A double as exact cents, so that sums do not depend on their order."""
    return F.col(c).cast("decimal(18,2)")
