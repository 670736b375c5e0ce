"""Skew-safe building blocks for per-key work.

One key may hold a third of all rows, so nothing here sends a whole key to one
task.  Ordered work is cut into time or number chunks: each (key, chunk) is a
small window partition, a per-chunk summary (one row per key and chunk, combined
map-side) carries state from chunk to chunk, and the carry is joined back on the
same (key, chunk) partitioning the window already needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread_by: Sequence[str],
    rank_col: str = "rank_in_key",
    salts: int = 64,
) -> DataFrame:
    """Exact first ``n`` rows per key; a hot key is first cut to ``n`` rows in each of ``salts`` slices."""
    slice_ = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", slice_)
        .withColumn("_pre", F.row_number().over(sliced))
        .filter(F.col("_pre") <= n)
        .drop("_slice", "_pre")
        .withColumn(rank_col, F.row_number().over(whole))
        .filter(F.col(rank_col) <= n)
    )


def _with_carry(df: DataFrame, keys: Sequence[str], summary: DataFrame) -> DataFrame:
    on = [*keys, CHUNK]
    return df.join(summary, on=on, how="left")


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    chunk: Column,
    out: str,
    inclusive: bool = False,
) -> DataFrame:
    """Last non-null ``value`` in an earlier row of the same key (``inclusive``: or this row).

    ``chunk`` must not decrease along ``order``.
    """
    keys = list(keys)
    base = df.withColumn("_v", value).withColumn(CHUNK, chunk)
    position = F.struct(*order)
    present = F.col("_v").isNotNull()
    per_chunk = base.groupBy(*keys, CHUNK).agg(
        F.max_by(F.when(present, F.col("_v")), F.when(present, position)).alias("_last")
    )
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, CHUNK, F.last("_last", ignorenulls=True).over(over_chunks).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        _with_carry(base.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)), keys, carried)
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_v", "_in", "_carry", CHUNK)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    chunk: Column,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` along ``order`` within each key, current row included."""
    keys = list(keys)
    base = df.withColumn("_v", value).withColumn(CHUNK, chunk)
    per_chunk = base.groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_total"))
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, CHUNK, F.sum("_total").over(over_chunks).alias("_carry"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(base.withColumn("_in", F.sum("_v").over(inside)), keys, carried)
        .withColumn(out, F.coalesce(F.col("_carry"), F.lit(0)) + F.col("_in"))
        .drop("_v", "_in", "_carry", CHUNK)
    )


def global_row_number(df: DataFrame, order: str, chunk: Column, out: str) -> DataFrame:
    """1-based position in the whole table; only one summary row per chunk meets in one task."""
    base = df.withColumn(CHUNK, chunk)
    sizes = base.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(CHUNK).orderBy(order)
    return (
        base.withColumn("_in", F.row_number().over(inside))
        .join(offsets, on=CHUNK)
        .withColumn(out, (F.col("_offset") + F.col("_in")).cast("long"))
        .drop("_in", "_offset", CHUNK)
    )


def rows_in_trailing_window(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    ts: str,
    width_seconds: int,
    chunk_seconds: int,
    out: str,
) -> DataFrame:
    """Number of other rows of the key with ``ts - width <= other.ts <= ts`` for each row, without forming pairs.

    Rows of an instant are one entry, which looks up the running count at its own time and just before the window starts.
    Null keys are a key, and rows without a time have those of the key without a time, as in a window of SQL.
    """
    key = F.struct(*keys).alias("_key")  # a struct is equal to itself, also where it holds nulls
    rows = df.select(key, F.col(id_col), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    rows = rows.withColumn("_place", F.struct("_key", F.col("_at").alias("at")))
    instants = rows.groupBy("_place", "_key", "_at").agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(1))
    probes = instants.select(
        "_place",
        "_key",
        (F.col("_at") - F.lit(width_seconds * 1_000_000)).alias("_at"),
        F.lit(0).cast("long").alias("_n"),
        F.lit(0).alias("_side"),  # a probe sorts before rows of the same instant
    )
    counted = running_sum(
        instants.unionByName(probes),
        ["_key"],
        ["_at", "_side"],
        F.col("_n"),
        F.floor(F.col("_at") / F.lit(chunk_seconds * 1_000_000)),
        "_running",
    )
    found = counted.groupBy("_place").agg(
        F.sum(F.when(F.col("_side") == 1, F.col("_running")).otherwise(-F.col("_running"))).alias("_found")
    )
    return rows.join(found, "_place").select(
        *[F.col("_key")[k].alias(k) for k in keys], id_col, (F.col("_found") - 1).cast("long").alias(out)
    )


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    gap_seconds: Column,
    chunk: Column,
    out: str = "session_start",
) -> DataFrame:
    """Label rows with the start of their gap-based session.  ``gap_seconds`` is read on the earlier row."""
    ends = previous_value(
        df.withColumn("_end", F.unix_micros(F.col(ts).cast("timestamp")) + gap_seconds.cast("long") * 1_000_000),
        keys,
        [ts, tie],
        F.col("_end"),
        chunk,
        "_prev_end",
    )
    opens = F.col("_prev_end").isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) >= F.col("_prev_end"))
    return previous_value(
        ends.withColumn("_open", F.when(opens, F.col(ts))),
        keys,
        [ts, tie],
        F.col("_open"),
        chunk,
        out,
        inclusive=True,
    ).drop("_end", "_prev_end", "_open")
