"""Registration of queries together with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Derived inputs as DuckDB SQL; a query's SQL gets those that it names.
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """sql with the views that it needs, directly or through others, in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    ctes = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in needed)
    sql = sql.strip()
    if not ctes:
        return sql
    return f"WITH {ctes},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes}\n{sql}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = with_views(sql)
        return f

    return register
