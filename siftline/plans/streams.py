"""Streams over the driver tables: each query runs a stream over all input into a table and reads the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftline.lexicons.builtin import LATIN
from siftline.operators import sessions
from siftline.plans import registry
from siftline.plans.registry import query
from siftline.session import ensure_checkpoint_dir
from siftline.sources.tables import SCHEMAS
from siftline.streaming import jobs, processors

HOURS = 3600
IDLE = 2 * HOURS


def folder(t) -> str:
    """A new folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def read(t, table: str):
    """A table as a stream.  Its name is a pattern, because a stream takes a folder or a pattern, and a table may be one file."""
    return jobs.read_files(t.spark, f"{t.directory}/{table[:-1]}[{table[-1]}].parquet", SCHEMAS[table])


def events(t):
    return read(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def at(column: str):
    return F.timestamp_micros(column).cast("timestamp_ntz")


@query(
    "stream_dedup_run",
    """WITH RECURSIVE chain AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY 1
          UNION ALL SELECT c.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = c.user_id
                                       AND e.ts > c.anchor + INTERVAL 48 HOUR) FROM chain c WHERE c.anchor IS NOT NULL)
       SELECT c.user_id, min(e.event_id) AS event_id, c.anchor FROM chain c JOIN events e ON e.user_id = c.user_id AND e.ts = c.anchor GROUP BY ALL""",
)
def stream_dedup_run(t):
    """Continuous deduplication: the first event of a user, then each first one 48 hours after the last that counted."""
    found = processors.drained(processors.ttl_anchors(events(t), "user_id", "ts", "event_id", 48 * HOURS), folder(t))
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), at("at").alias("anchor"))


@query(
    "stream_idle_run",
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL {IDLE} SECOND THEN 1 ELSE 0 END AS opens FROM events
                  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS part FROM e),
            s AS (SELECT user_id, part, max(ts) AS last_seen, count(*) AS events FROM n GROUP BY ALL)
       SELECT user_id, last_seen, events FROM s
       WHERE part < (SELECT max(x.part) FROM s x WHERE x.user_id = s.user_id) OR last_seen + INTERVAL {IDLE} SECOND < (SELECT max(ts) FROM events)""",
)
def stream_idle_run(t):
    """Silences of users of more than two hours, found by timers; state of silent users is dropped."""
    found = processors.drained(processors.idle_keys(events(t), "user_id", "ts", IDLE), folder(t))
    return found.select(F.col("key").alias("user_id"), at("at").alias("last_seen"), "events")


@query("stream_breaker_run", registry.SQL["circuit_state"])
def stream_breaker_run(t):
    """The breakers of ``circuit_state`` as a stream."""
    start, step, _ = sessions.circuit(failures=2, cool_down=6 * HOURS)
    calls = events(t).withColumn("failed", (F.col("event_type") == "error").cast("int"))
    found = processors.drained(processors.breakers(calls, "user_id", "ts", "event_id", "failed", start, step, 12 * HOURS), folder(t))
    return found.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "state", "called")


@query(
    "stream_hourly_run",
    """SELECT date_trunc('hour', ts) AS hour_start, CASE WHEN value >= 70 THEN 'HOT' WHEN value >= 50 THEN 'WARM'
              ELSE 'COLD' END AS tier, count(*) AS n FROM events
       GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""",
)
def stream_hourly_run(t):
    """Hourly counts that are final: hours that the watermark has passed."""
    found = processors.drained(jobs.hourly_tiers(events(t), "ts", "value", "0 seconds"), folder(t))
    return found.select(F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "tier", "n")


@query("stream_triage_run", registry.SQL["stream_triage"])
def stream_triage_run(t):
    """Continuous triage of documents into a table with one row for each text hash."""
    target = folder(t)
    running = jobs.triage(read(t, "documents"), LATIN, f"{target}/table", f"{target}/state")
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return t.spark.read.parquet(f"{target}/table").select("hash", "doc_id", "stage", "tier", "last_seen")
