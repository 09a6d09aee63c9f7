"""Names of the registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import alerts, assembly, scalars, sources, traces

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [traces, scalars, alerts, assembly, sources]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
