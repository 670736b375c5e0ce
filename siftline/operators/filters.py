"""Row filters and small projections."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matching(df: DataFrame, equal: Mapping[str, object | None]) -> DataFrame:
    """AND of equality tests; a criterion of ``None`` is left out."""
    given = {name: value for name, value in equal.items() if value is not None}
    return df.filter(all_of(F.col(name) == value for name, value in given.items()))


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def search_any(df: DataFrame, columns: Iterable[str], needle: str) -> DataFrame:
    """Case-insensitive substring search over several nullable columns."""
    pattern = f"%{like_escape(needle)}%"
    return df.filter(any_of(F.coalesce(F.col(c), F.lit("")).ilike(pattern) for c in columns))


def is_blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One alternation for all literal keywords, so that a text is scanned once."""
    return "(?iu)" + "|".join(f"\\Q{k}\\E" for k in keywords)


def contains_any(column: Column, keywords: Iterable[str]) -> Column:
    return F.coalesce(column.rlike(keyword_pattern(keywords)), F.lit(False))


def query_tokens(query: str, min_length: int = 3) -> list[str]:
    return [t for t in query.lower().split() if len(t) >= min_length]


def tokens_in_any(df: DataFrame, columns: Iterable[str], query: str, min_length: int = 3) -> DataFrame:
    """Rows where any query token occurs in any of the columns."""
    tokens = query_tokens(query, min_length)
    if not tokens:
        return df.limit(0)
    return df.filter(any_of(contains_any(F.col(c), tokens) for c in columns))


def since(ts: str, anchor: str, interval: str) -> Column:
    """``ts`` within ``interval`` before the anchor; both bounds fold to literals and reach the scan."""
    return F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{anchor}' - INTERVAL {interval}")


def on_days(ts: str, first: str, last: str) -> Column:
    """Closed range of whole days."""
    return (F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{first}'")) & (
        F.col(ts) < F.expr(f"TIMESTAMP_NTZ '{last}' + INTERVAL 1 DAY")
    )


def working_hours(ts: str, zone: str, first: int, end: int) -> Column:
    """Local hour in [first, end); ``ts`` is UTC."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    return (F.hour(local) >= first) & (F.hour(local) < end)


def preview(column: Column, size: int) -> Column:
    """Single-line preview with an ellipsis where text was cut."""
    flat = F.translate(column, "\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def short_hash(column: Column, size: int) -> Column:
    return F.substring(F.coalesce(column, F.lit("")), 1, size)


def clean_links(df: DataFrame, column: str, headers: Iterable[str]) -> DataFrame:
    """Trimmed, non-blank links that are not header cells."""
    link = F.trim(F.col(column))
    return (
        df.withColumn(column, link)
        .filter(F.col(column).isNotNull() & (F.col(column) != ""))
        .filter(~F.lower(F.col(column)).isin(*[h.lower() for h in headers]))
    )
