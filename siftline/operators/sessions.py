"""Keyed, time-ordered folds over event logs, in batch form."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators import keyed
from siftline.session import cut_lineage


def debounce(
    df: DataFrame, key: str, ts: str, tie: str, text: str, chunk: Column,
    fresh_gap: int = 7, usual_gap: int = 5, recent_gap: int = 2, recent_within: int = 300,
) -> DataFrame:
    """Messages of a sender merged until it is silent: longer for a new sender, shorter for one who wrote
    just before.  One row per burst with the texts in order."""
    before = keyed.previous_value(df, [key], [ts, tie], F.col(ts), chunk, "_before")
    since = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    gap = F.when(F.col("_before").isNull(), fresh_gap).when(since < recent_within * 1_000_000, recent_gap).otherwise(usual_gap)
    bursts = keyed.sessionize(before.withColumn("_gap", gap), [key], ts, tie, F.col("_gap"), chunk)
    lines = F.array_sort(F.collect_list(F.struct(ts, tie, text)))
    return bursts.groupBy(key, "session_start").agg(
        F.count(F.lit(1)).alias("messages"),
        F.max(ts).alias("session_end"),
        F.array_join(F.transform(lines, lambda m: m[text]), "\n").alias("merged"),
    )


def stale_ladder(latest: DataFrame, ts: str, level: str, outgoing: Column, managed: Column, now: Column) -> DataFrame:
    """Next follow-up level of conversations (``latest``: one row each with its newest message): level 1, 2, 3
    after 1, 3, 5 silent days when the last word was ours; an incoming message resets to 0."""
    silent = now - F.col(ts)
    due = (
        F.when((F.col(level) == 0) & (silent > F.expr("INTERVAL 1 DAY")), 1)
        .when((F.col(level) == 1) & (silent > F.expr("INTERVAL 3 DAY")), 2)
        .when((F.col(level) == 2) & (silent > F.expr("INTERVAL 5 DAY")), 3)
    )
    return latest.withColumn(
        "next_level", F.when(~outgoing, 0).when(managed, F.col(level)).otherwise(F.coalesce(due, F.col(level)))
    ).withColumn("send_follow_up", F.coalesce(outgoing & ~managed & due.isNotNull(), F.lit(False)))


def ordered_fold(
    df: DataFrame, key: str, ts: str, ident: str, extra: list[str], start: dict, step: Callable, outputs: str,
    slice_seconds: int, gap_seconds: float | None = None,
) -> DataFrame:
    """Fold the rows of each key in time order with a small state; ``step(state, seconds, *extra)`` returns
    (state, output values).

    Rows are sorted inside partitions and folded as they stream by, one batch at a time with the state carried on, so a
    key of any length takes the memory of a batch.  Where a silence of ``gap_seconds`` brings the state back to the
    start, keys are cut there first (with chunks of ``slice_seconds``), and the pieces are folded in parallel.
    """
    rows = df.select(key, ident, F.col(ts).alias("_ts"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_at"), *extra)
    piece = [key]
    if gap_seconds is not None:
        chunk = F.floor(F.col("_at") / slice_seconds).cast("long")
        rows = keyed.sessionize(rows, [key], "_ts", ident, F.lit(math.ceil(gap_seconds)), chunk, "_piece")
        piece = [key, "_piece"]
    names = [part.strip().split(" ")[0] for part in outputs.split(",")]
    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, {outputs}"

    def fold(batches):
        current, state = None, None
        for batch in batches:
            results = {n: [] for n in names}
            for mark, values in zip(zip(*[batch[c] for c in piece]), batch[["_at", *extra]].itertuples(index=False, name=None)):
                if current is None or any(x is not y and x != y and not (x != x and y != y) for x, y in zip(mark, current)):
                    current, state = mark, dict(start)
                state, out = step(state, *values)
                for n, v in zip(names, out):
                    results[n].append(v)
            yield pd.DataFrame({key: batch[key], ident: batch[ident], **results})

    columns = [key, ident, "_at", *extra, *piece[1:]]
    return rows.select(*columns).repartition(*piece).sortWithinPartitions(*piece, "_at", ident).mapInPandas(fold, schema)


#: Rows of all keys in a time chunk.
CHUNK_ROWS = 1_000_000


def chunked_fold(
    df: DataFrame, key: str, ts: str, ident: str, extra: list[str], start: dict, step: Callable, outputs: str, slice_seconds: float | None = None
) -> DataFrame:
    """``ordered_fold`` for keys that one task cannot fold: time chunks of a key are folded in parallel.

    Without ``slice_seconds`` chunks are as long as CHUNK_ROWS rows of all keys take; fewer rows than that need no chunks.

    A chunk's first state is the last one of the chunk before it, which is not known yet; it is guessed to be the start.  Chunks
    whose guess was wrong are folded again from the state found, until no guess changes.  A fold that forgets (a breaker after a
    call that works, a bucket that is full) ends in the same state from either, so few chunks are folded twice; in the
    worst case there are as many rounds as chunks.  Only one summary row of each chunk meets those of its key.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    if slice_seconds is None:
        n, first, last = df.agg(F.count(F.lit(1)), F.min(micros), F.max(micros)).first()
        if n <= CHUNK_ROWS:
            return ordered_fold(df, key, ts, ident, extra, start, step, outputs, 0)
        slice_seconds = max(1e-6, (last - first) / 1e6 / (n / CHUNK_ROWS))
    rows = df.select(F.col(key).alias("_key"), ident, (micros / 1e6).alias("_at"), F.floor(micros / (slice_seconds * 1_000_000)).alias("_chunk"), *extra)
    names = [part.strip().split(" ")[0] for part in outputs.split(",")]
    kinds = dict(rows.dtypes)
    marks, fields = f"_key {kinds['_key']}, _chunk bigint", list(start)
    begin = _packed([start[f] for f in fields])

    def run(batches, emit, finish):
        """Rows come sorted by (key, chunk, time); ``emit`` gets the outputs of a batch, ``finish`` the last state of each chunk."""
        mark = state = first = None
        for batch in batches:
            results, ended = [], []
            keys = batch["_key"].where(batch["_key"].notna(), None)
            for k, chunk, packed, *values in zip(keys, batch["_chunk"], batch["_start"], batch["_at"], *[batch[c] for c in extra]):
                if mark != (k, chunk):
                    if mark is not None:
                        ended.append((*mark, first, _packed([state[f] for f in fields])))
                    mark, first = (k, chunk), bytes(packed)
                    state = dict(zip(fields, json.loads(first)))
                state, out = step(state, *values)
                results.append(out)
            yield emit(batch, results) if emit else pd.DataFrame(ended, columns=["_key", "_chunk", "_start", "_end"])
        if finish and mark is not None:
            yield pd.DataFrame([(*mark, first, _packed([state[f] for f in fields]))], columns=["_key", "_chunk", "_start", "_end"])

    def folded(started: DataFrame, work, schema: str) -> DataFrame:
        return started.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_at", ident).mapInPandas(work, schema)

    def ends(started: DataFrame) -> DataFrame:
        return folded(started, lambda batches: run(batches, None, True), f"{marks}, _start binary, _end binary")

    def judged(batches):
        def emit(batch, results):
            columns = zip(*results) if results else [[] for _ in names]
            return pd.DataFrame({key: batch["_key"], ident: batch[ident], **dict(zip(names, map(list, columns)))})

        return run(batches, emit, False)

    def at_chunks(chunks: DataFrame) -> DataFrame:
        named = chunks.select(F.col("_key").alias("_of"), F.col("_chunk").alias("_in"), "_start")
        return rows.join(named, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_in"))).drop("_of", "_in")

    known = cut_lineage(ends(rows.withColumn("_start", F.lit(begin))))
    while True:
        before = F.lag("_end").over(Window.partitionBy("_key").orderBy("_chunk"))
        due = cut_lineage(known.withColumn("_due", F.coalesce(before, F.lit(begin))))
        wrong = due.where("_due <> _start").select("_key", "_chunk", F.col("_due").alias("_start"))
        if wrong.isEmpty():
            break
        known = cut_lineage(due.where("_due = _start").drop("_due").union(ends(at_chunks(wrong))))
    return folded(at_chunks(known), judged, f"`{key}` {kinds['_key']}, `{ident}` {kinds[ident]}, {outputs}")


def _packed(values: list) -> bytes:
    """A state of numbers, texts, flags and nulls; equal states have equal bytes."""
    return json.dumps(values).encode()


def token_bucket(capacity: float, per_second: float):
    """(start, step, outputs) of a token bucket: allowed at once, or the seconds to wait."""

    def step(state, at):
        last = state["last"] if state["last"] >= 0 else at
        tokens = min(capacity, state["tokens"] + max(0.0, at - last) * per_second)
        if tokens >= 1.0:
            return {"tokens": tokens - 1.0, "last": at}, (True, 0.0)
        return {"tokens": tokens, "last": at}, (False, (1.0 - tokens) / per_second)

    return {"tokens": float(capacity), "last": -1.0}, step, "allowed BOOLEAN, wait_seconds DOUBLE"


def circuit(failures: int = 5, cool_down: float = 60.0):
    """(start, step, outputs) of a breaker derived from a call log; the extra column is 1 for a failed call."""
    CLOSED, OPEN, HALF = 0.0, 1.0, 2.0
    names = {CLOSED: "CLOSED", OPEN: "OPEN", HALF: "HALF_OPEN"}

    def step(state, at, failed):
        mode, count, opened = state["mode"], state["count"], state["opened"]
        if mode == OPEN and at - opened >= cool_down:
            mode = HALF
        if mode == OPEN:
            return {"mode": mode, "count": count, "opened": opened}, (names[OPEN], False)
        seen = names[mode]
        if failed:
            count += 1
            if mode == HALF or count >= failures:
                mode, opened = OPEN, at
        else:
            mode, count = CLOSED, 0.0
        return {"mode": mode, "count": count, "opened": opened}, (seen, True)

    return {"mode": CLOSED, "count": 0.0, "opened": -1.0}, step, "state STRING, called BOOLEAN"


def route_by_tier(tier: Column, priority: Column, ts: Column) -> Column:
    """struct(route, due_at, escalate): hot now, warm after a minute, cold never."""
    return F.struct(
        F.when(tier == "HOT", "immediate").when(tier == "WARM", "delayed").otherwise("none").alias("route"),
        F.when(tier == "HOT", ts).when(tier == "WARM", ts + F.expr("INTERVAL 60 SECOND")).alias("due_at"),
        ((tier == "HOT") & (priority >= 80)).alias("escalate"),
    )


def cache_lookup(df: DataFrame, key: str, ts: str, tie: str, chunk: Column, ttl: str = "INTERVAL 24 HOUR") -> DataFrame:
    """Whether an earlier call with the same key is younger than the time to live."""
    seen = keyed.previous_value(df, [key], [ts, tie], F.col(ts), chunk, "cached_at")
    return seen.withColumn("hit", F.coalesce(F.col("cached_at") > F.col(ts) - F.expr(ttl), F.lit(False)))


def idle_keys(df: DataFrame, key: str, ts: str, now: Column, idle: str = "INTERVAL 10 MINUTE") -> DataFrame:
    """Keys with their last activity and whether their state may be dropped."""
    return df.groupBy(key).agg(F.max(ts).alias("last_seen")).withColumn(
        "evict", F.col("last_seen") < now - F.expr(idle)
    )
