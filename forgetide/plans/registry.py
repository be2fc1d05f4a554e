"""The query table: name -> job, and name -> DuckDB text giving the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgetide.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under `name`, with its DuckDB twin when SQL can state it."""
    def register(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(configure(spark), sf_dir)
        run.__name__, run.__doc__ = name, job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job
    return register
