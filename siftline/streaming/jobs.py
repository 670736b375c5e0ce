"""The stateful computations on Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.functions import text as T
from siftline.lexicons.model import Lexicon
from siftline.operators import cascade, tables
from siftline.session import cut_lineage


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def dedup_ttl(events: DataFrame, key: str, ts: str, ident: str, ttl_seconds: int, lateness: str) -> DataFrame:
    """First event per key and ``ttl`` after its anchor.  The state of a key is its anchor; it is dropped
    when the watermark has passed it by the time to live."""
    types = dict(events.dtypes)
    schema = f"`{key}` {types[key]}, `{ident}` {types[ident]}, anchor TIMESTAMP"

    def keep(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        anchor = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, ident], kind="stable")
        ids, anchors = [], []
        for at, row_id in rows[[ts, ident]].itertuples(index=False, name=None):
            seconds = at.timestamp()
            if anchor is None or seconds - anchor > ttl_seconds:
                anchor = seconds
                ids.append(row_id)
                anchors.append(at)
        state.update((anchor,))
        state.setTimeoutTimestamp(max(int((anchor + ttl_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(ids), ident: ids, "anchor": anchors})

    return (
        events.withWatermark(ts, lateness)
        .groupBy(key)
        .applyInPandasWithState(keep, schema, "anchor DOUBLE", "append", GroupStateTimeout.EventTimeTimeout)
    )


def token_bucket(
    events: DataFrame, key: str, ts: str, ident: str, capacity: float, per_second: float, idle_seconds: int, lateness: str
) -> DataFrame:
    """Allowed or seconds to wait per event; a key idle for ``idle_seconds`` loses its state (its bucket is
    full again by then)."""
    types = dict(events.dtypes)
    schema = f"`{key}` {types[key]}, `{ident}` {types[ident]}, allowed BOOLEAN, wait_seconds DOUBLE"

    def fold(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values([ts, ident], kind="stable")
        out = []
        for at, row_id in rows[[ts, ident]].itertuples(index=False, name=None):
            seconds = at.timestamp()
            tokens = min(capacity, tokens + max(0.0, seconds - (last if last is not None else seconds)) * per_second)
            last = seconds
            if tokens >= 1.0:
                tokens -= 1.0
                out.append((name[0], row_id, True, 0.0))
            else:
                out.append((name[0], row_id, False, (1.0 - tokens) / per_second))
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + idle_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ident, "allowed", "wait_seconds"])

    return (
        events.withWatermark(ts, lateness)
        .groupBy(key)
        .applyInPandasWithState(fold, schema, "tokens DOUBLE, last DOUBLE", "append", GroupStateTimeout.EventTimeTimeout)
    )


def follow_ups(messages: DataFrame, key: str, ts: str, outgoing: str, steps: list[int], lateness: str) -> DataFrame:
    """Follow-up levels by timers: when a conversation whose last word was ours stays silent for the next
    step (seconds), its level rises; an incoming message resets it."""
    types = dict(messages.dtypes)
    schema = f"`{key}` {types[key]}, level INT, silent_since TIMESTAMP"

    def ladder(name, batches, state: GroupState):
        if state.hasTimedOut:
            level, last = state.get
            level += 1
            if level < len(steps):
                state.update((level, last))
                state.setTimeoutTimestamp(
                    max(int((last + steps[level]) * 1000) + 1, state.getCurrentWatermarkMs() + 1)
                )
            else:
                state.remove()
            yield pd.DataFrame({key: [name[0]], "level": [level], "silent_since": [pd.Timestamp(last, unit="s")]})
            return
        level, last = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        ours = bool(rows[outgoing].iloc[-1])
        if not rows[outgoing].all():
            level = 0
        last = max(last, rows[ts].iloc[-1].timestamp())
        if not ours:
            if state.exists:
                state.remove()
            return
        state.update((level, last))
        state.setTimeoutTimestamp(max(int((last + steps[level]) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        return
        yield

    return (
        messages.withWatermark(ts, lateness)
        .groupBy(key)
        .applyInPandasWithState(ladder, schema, "level INT, last DOUBLE", "append", GroupStateTimeout.EventTimeTimeout)
    )


def sessions(messages: DataFrame, key: str, ts: str, text: str, gap: Column, lateness: str) -> DataFrame:
    """Bursts of messages per sender, closed by silence; the gap may depend on the row."""
    lines = F.array_sort(F.collect_list(F.struct(ts, text)))
    return (
        messages.withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.transform(lines, lambda m: m[text]), "\n").alias("merged"))
        .select(key, F.col("s.start").alias("session_start"), "messages", "merged")
    )


def hourly_tiers(events: DataFrame, ts: str, value: str, lateness: str) -> DataFrame:
    """Counts per hour and tier; an hour is final once the watermark has passed it."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 hour").alias("w"), cascade.tier_of(F.col(value)).alias("tier"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("average"))
        .select(F.col("w.start").alias("hour_start"), "tier", "n", "average")
    )


def upsert_batch(path: str, buckets: int = 64):
    """foreachBatch sink: upsert by hash into a Parquet table partitioned by hash bucket.

    Only the buckets a batch touches are read and replaced.  Repeating a batch changes nothing, because an
    upsert of the same rows gives the same table.  Where batches touch most buckets, ``append_batch`` writes less.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        incoming = cut_lineage(batch.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")))
        touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        schema = incoming.schema
        try:
            stored = spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(touched))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # a table that cannot be read is not an empty one
                raise
            stored = incoming.limit(0)  # the first batch finds no table
        keep = [c for c in columns if c not in ("hash", "last_seen")] + ["bucket"]
        merged = tables.upsert_first_wins(stored.select(*incoming.columns), incoming, "hash", [keep[0]], "last_seen", keep)
        (
            cut_lineage(merged)
            .repartition("bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(path)
        )

    return write


def append_batch(path: str):
    """foreachBatch sink: each batch is one partition of a Parquet table, upserted within itself; nothing is rewritten.

    A repeated batch replaces its own partition.  ``folded`` reads the table, ``compact`` writes it as one batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keep = [c for c in batch.columns if c not in ("hash", "last_seen")]
        once = tables.upsert_first_wins(batch.limit(0), batch, "hash", [keep[0]], "last_seen", keep)
        once.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def folded(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hash: the first write, and the last time it was seen."""
    rows = spark.read.parquet(path)
    keep = [c for c in rows.columns if c not in ("hash", "last_seen", "batch")]
    return tables.upsert_first_wins(rows.limit(0), rows, "hash", ["batch", keep[0]], "last_seen", keep)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The folded table as batch -1 of a new table, for later batches to be appended to."""
    folded(spark, path).write.mode("overwrite").parquet(f"{target}/batch=-1")


def triage(
    messages: DataFrame, lexicon: Lexicon, path: str, checkpoint: str, ident: str = "doc_id", text: str = "text",
    seconds: int | None = None, sink=upsert_batch,
) -> StreamingQuery:
    """Continuous triage: features, decision and priority of each new message, upserted by text hash.

    ``seconds`` sets the rest between micro-batches; without it all available input is processed once.  ``sink``:
    ``upsert_batch`` keeps one row for each hash on disk, ``append_batch`` one for each hash and batch.
    """
    decided = cascade.triage(messages, lexicon, text).select(
        T.text_hash(F.col(text)).alias("hash"), ident, "stage", "tier", "priority", F.col(ident).alias("last_seen")
    )
    writer = decided.writeStream.foreachBatch(sink(path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()
