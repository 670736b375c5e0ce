"""Registry of runnable queries: name -> (plan, optional SQL with the same result)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the driver tables, with its SQL where there is one."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name!r} registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, sf_dir: plan(Tables(spark, sf_dir))

    return {name: bind(plan) for name, plan in PLANS.items()}
