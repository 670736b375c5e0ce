"""Reporting aggregations: every report is one pass with conditional counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n() -> Column:
    return F.count(F.lit(1))


def counts(conditions: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))


def by_group(df: DataFrame, column: str, top: int | None = None, default: str | None = None) -> DataFrame:
    """Counts per value, largest first."""
    value = F.coalesce(F.col(column), F.lit(default)) if default is not None else F.col(column)
    grouped = df.groupBy(value.alias(column)).agg(n().alias("n")).orderBy(F.desc("n"), column)
    return grouped.limit(top) if top else grouped


def timeline(df: DataFrame, ts: str, pattern: str) -> DataFrame:
    """Counts per formatted time step."""
    return df.groupBy(F.date_format(ts, pattern).alias("bucket")).agg(n().alias("n"))


def dense_days(df: DataFrame, ts: str, first: str, last: str, measures: Sequence[Column]) -> DataFrame:
    """One row per calendar day, days without rows included."""
    calendar = df.sparkSession.sql(
        f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS day"
    )
    daily = (
        df.filter((F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{first}'")) & (
            F.col(ts) < F.expr(f"TIMESTAMP_NTZ '{last}' + INTERVAL 1 DAY")))
        .groupBy(F.to_date(ts).alias("day")).agg(*measures)
    )
    names = [c for c in daily.columns if c != "day"]
    return calendar.join(daily, "day", "left").fillna(0, subset=names)


def period_trend(df: DataFrame, ts: str, anchor: str, days: int) -> DataFrame:
    """Count of the period before the anchor against the equal period before that."""
    now = F.expr(f"TIMESTAMP_NTZ '{anchor}'")
    middle = F.expr(f"TIMESTAMP_NTZ '{anchor}' - INTERVAL {days} DAY")
    start = F.expr(f"TIMESTAMP_NTZ '{anchor}' - INTERVAL {2 * days} DAY")
    both = df.filter((F.col(ts) >= start) & (F.col(ts) < now)).agg(
        F.count_if(F.col(ts) >= middle).alias("current"), F.count_if(F.col(ts) < middle).alias("previous")
    )
    change = F.when(
        F.col("previous") == 0, F.when(F.col("current") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    ).otherwise((F.col("current") - F.col("previous")) * 100.0 / F.col("previous"))
    return both.select(
        "current",
        "previous",
        F.when(change >= 0, "up").otherwise("down").alias("direction"),
        F.round(F.abs(change), 1).alias("change_percent"),
    )
