"""All registered queries of the engine, and their SQL. Importing aspects registers every plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thriftline.plans import aspects, extra, filters, more, outline, sinks, testruns, tools  # noqa: F401
from thriftline.plans.registry import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
