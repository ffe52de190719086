"""Registration of a query over the domain tables together with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyspine.session import configure
from skyspine.standins import check_sql, domain_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of (tables, spark). ``sql`` may name stand-ins as tables."""
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return build(domain_tables(spark, sf_dir), spark)

        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = check_sql(sql)
        return build
    return register
