"""Registry of queries: a name, a Spark plan and, where it exists, equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.plans.inputs import Inputs
from stratalens.plans.sqlbase import complete

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan ``f(inputs) -> DataFrame`` under an inventory name."""

    def register(plan: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = complete(sql)
        return plan

    return register
