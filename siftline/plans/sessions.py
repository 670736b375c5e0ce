"""Stateful computations over the events, in batch form; ``siftline.streaming`` has the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.lexicons.builtin import LATIN
from siftline.operators import cascade, dedup, sessions, tables as jobs
from siftline.plans.joins import by_day
from siftline.plans.registry import query
from siftline.plans.rules import _BOOSTED
from siftline.plans.scans import EVENTS_NOW
from siftline.plans.text_functions import SQL_SPACE

HOURS = 3600


@query(
    "session_debounce",
    """WITH p AS (SELECT *, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            g AS (SELECT *, ts + (CASE WHEN prev IS NULL THEN 7 WHEN ts - prev < INTERVAL 2 HOUR THEN 2 ELSE 5 END)
                             * INTERVAL 1 HOUR AS until FROM p),
            o AS (SELECT *, CASE WHEN lag(until) OVER w IS NULL OR ts >= lag(until) OVER w THEN ts END AS opened
                  FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            s AS (SELECT *, max(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_start FROM o)
       SELECT user_id, session_start, count(*) AS messages, max(ts) AS session_end,
              string_agg(event_type, chr(10) ORDER BY ts, event_id) AS merged
       FROM s GROUP BY user_id, session_start""",
)
def session_debounce(t):
    """The events are hours apart, so the gaps are 7, 5 and 2 hours instead of seconds."""
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    return sessions.debounce(
        events, "user_id", "ts", "event_id", "event_type", by_day(), 7 * HOURS, 5 * HOURS, 2 * HOURS, 2 * HOURS
    )


@query(
    "stale_ladder",
    """WITH m AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS kind,
                         CAST(least(count(*) FILTER (event_type = 'signup'), 2) AS INTEGER) AS level FROM events GROUP BY 1),
            d AS (SELECT *, TIMESTAMP '2024-02-03 12:00:00' - ts AS silent, kind IN ('view', 'click', 'purchase') AS outgoing,
                         kind = 'purchase' AS managed FROM m),
            n AS (SELECT *, CASE WHEN level = 0 AND silent > INTERVAL 1 DAY THEN 1 WHEN level = 1 AND silent > INTERVAL 3 DAY
                         THEN 2 WHEN level = 2 AND silent > INTERVAL 5 DAY THEN 3 END AS due FROM d)
       SELECT user_id, level, CAST(CASE WHEN NOT outgoing THEN 0 WHEN managed THEN level ELSE coalesce(due, level) END AS INTEGER)
                AS next_level, outgoing AND NOT managed AND due IS NOT NULL AS send_follow_up FROM n""",
)
def stale_ladder(t):
    latest = t.events.groupBy("user_id").agg(
        F.max("ts").alias("ts"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"),
        F.least(F.count_if(F.col("event_type") == "signup"), F.lit(2)).cast("int").alias("level"),
    )
    outgoing, managed = F.col("kind").isin("view", "click", "purchase"), F.col("kind") == "purchase"
    now = F.expr("TIMESTAMP_NTZ '2024-02-03 12:00:00'")
    return sessions.stale_ladder(latest, "ts", "level", outgoing, managed, now).select(
        "user_id", "level", "next_level", "send_follow_up"
    )


@query(
    "token_bucket",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS sec,
                                 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
            f AS (SELECT event_id, event_type, sec, rn, 4.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS wait
                  FROM e WHERE rn = 1
                  UNION ALL
                  SELECT event_id, event_type, sec, rn, CASE WHEN t >= 1.0 THEN t - 1.0 ELSE t END, t >= 1.0,
                         CASE WHEN t >= 1.0 THEN 0.0 ELSE (1.0 - t) / (1.0::DOUBLE / 900) END
                  FROM (SELECT e.*, least(5.0::DOUBLE, f.tokens + greatest(0.0, e.sec - f.sec) * (1.0::DOUBLE / 900)) AS t
                        FROM f JOIN e ON e.event_type = f.event_type AND e.rn = f.rn + 1))
       SELECT event_id, event_type, allowed, round(wait, 3) AS wait_seconds FROM f""",
)
def token_bucket(t):
    """Rate-limit analysis per event type: bursts of 5, one more every 15 minutes."""
    start, step, outputs = sessions.token_bucket(5, 1 / 900)
    judged = sessions.ordered_fold(t.events, "event_type", "ts", "event_id", [], start, step, outputs, 86400, gap_seconds=5 * 900)
    return judged.select("event_id", "event_type", "allowed", F.round("wait_seconds", 3).alias("wait_seconds"))


@query(
    "circuit_state",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, event_type = 'error' AS failed,
                                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
            f AS (SELECT event_id, user_id, rn, 0 AS mode, failed::INT AS fails, -1.0::DOUBLE AS opened, 0 AS seen
                  FROM e WHERE rn = 1
                  UNION ALL
                  SELECT event_id, user_id, rn,
                         CASE WHEN m = 1 THEN 1 WHEN NOT failed THEN 0 WHEN m = 2 OR fails + 1 >= 2 THEN 1 ELSE m END,
                         CASE WHEN m = 1 THEN fails WHEN NOT failed THEN 0 ELSE fails + 1 END,
                         CASE WHEN m <> 1 AND failed AND (m = 2 OR fails + 1 >= 2) THEN sec ELSE opened END, m
                  FROM (SELECT e.*, f.fails, f.opened,
                               CASE WHEN f.mode = 1 AND e.sec - f.opened >= 6 * 3600 THEN 2 ELSE f.mode END AS m
                        FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
       SELECT event_id, user_id, ['CLOSED', 'OPEN', 'HALF_OPEN'][seen + 1] AS state, seen <> 1 AS called FROM f""",
)
def circuit_state(t):
    """Breaker state of each user's calls; an ``error`` event is a failed call."""
    start, step, outputs = sessions.circuit(failures=2, cool_down=6 * HOURS)
    calls = t.events.withColumn("failed", (F.col("event_type") == "error").cast("int"))
    return sessions.chunked_fold(calls, "user_id", "ts", "event_id", ["failed"], start, step, outputs)


@query(
    "circuit_state_of_all",
    """WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) / 1e6 AS sec, event_type = 'error' AS failed,
                                 row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
            f AS (SELECT event_id, rn, 0 AS mode, failed::INT AS fails, -1.0::DOUBLE AS opened, 0 AS seen FROM e WHERE rn = 1
                  UNION ALL
                  SELECT event_id, rn,
                         CASE WHEN m = 1 THEN 1 WHEN NOT failed THEN 0 WHEN m = 2 OR fails + 1 >= 5 THEN 1 ELSE m END,
                         CASE WHEN m = 1 THEN fails WHEN NOT failed THEN 0 ELSE fails + 1 END,
                         CASE WHEN m <> 1 AND failed AND (m = 2 OR fails + 1 >= 5) THEN sec ELSE opened END, m
                  FROM (SELECT e.*, f.fails, f.opened, CASE WHEN f.mode = 1 AND e.sec - f.opened >= 3600 THEN 2 ELSE f.mode END AS m
                        FROM f JOIN e ON e.rn = f.rn + 1))
       SELECT event_id, ['CLOSED', 'OPEN', 'HALF_OPEN'][seen + 1] AS state, seen <> 1 AS called FROM f""",
)
def circuit_state_of_all(t):
    """One breaker for the calls of all users: a single key, folded in chunks of a day."""
    start, step, outputs = sessions.circuit(failures=5, cool_down=HOURS)
    calls = t.events.select("event_id", "ts", (F.col("event_type") == "error").cast("int").alias("failed"), F.lit("all").alias("breaker"))
    return sessions.chunked_fold(calls, "breaker", "ts", "event_id", ["failed"], start, step, outputs, 86400).drop("breaker")


@query(
    "idle_state_eviction",
    """SELECT user_id, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-30 11:50:00' AS evict
       FROM events GROUP BY user_id""",
)
def idle_state_eviction(t):
    return sessions.idle_keys(t.events, "user_id", "ts", F.expr(f"TIMESTAMP_NTZ '{EVENTS_NOW}'"))


@query(
    "tier_routing",
    """SELECT event_id, CASE WHEN value >= 70 THEN 'immediate' WHEN value >= 50 THEN 'delayed' ELSE 'none' END AS route,
              CASE WHEN value >= 70 THEN ts WHEN value >= 50 THEN ts + INTERVAL 60 SECOND END AS due_at,
              value >= 80 AS escalate FROM events""",
)
def tier_routing(t):
    routed = sessions.route_by_tier(cascade.tier_of(F.col("value")), F.col("value"), F.col("ts"))
    return t.events.select("event_id", routed.alias("r")).select("event_id", "r.route", "r.due_at", "r.escalate")


@query(
    "cache_ttl_lookup",
    """WITH c AS (SELECT event_id, ts, md5(substr(event_type, 1, 200) || '||' || user_id) AS key FROM events),
            l AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS cached_at FROM c)
       SELECT event_id, cached_at, coalesce(cached_at > ts - INTERVAL 24 HOUR, false) AS hit FROM l""",
)
def cache_ttl_lookup(t):
    calls = t.events.select(
        "event_id", "ts", T.cache_key(F.col("event_type"), F.col("user_id").cast("string")).alias("key")
    )
    return sessions.cache_lookup(calls, "key", "ts", "event_id", by_day()).select("event_id", "cached_at", "hit")


@query(
    "stream_dedup_48h",
    """WITH RECURSIVE chain AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY 1
          UNION ALL SELECT c.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = c.user_id
                                       AND e.ts > c.anchor + INTERVAL 48 HOUR) FROM chain c WHERE c.anchor IS NOT NULL)
       SELECT user_id, count(*) AS kept, max(anchor) AS last_anchor FROM chain WHERE anchor IS NOT NULL GROUP BY user_id""",
)
def stream_dedup_48h(t):
    """Batch twin of the streaming deduplication."""
    anchors = dedup.ttl_anchors(t.events, "user_id", "ts", 48 * HOURS)
    return anchors.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.max("anchor").alias("last_anchor"))


@query(
    "hourly_tier_stream",
    """SELECT date_trunc('hour', ts) AS hour_start, CASE WHEN value >= 70 THEN 'HOT' WHEN value >= 50 THEN 'WARM'
              ELSE 'COLD' END AS tier, count(*) AS n FROM events GROUP BY 1, 2""",
)
def hourly_tier_stream(t):
    """Batch twin of the hourly stream."""
    return t.events.groupBy(
        F.window("ts", "1 hour").alias("w"), cascade.tier_of(F.col("value")).alias("tier")
    ).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour_start"), "tier", "n")


@query(
    "stream_triage",
    f"""WITH {_BOOSTED}, h AS (SELECT *, md5(regexp_replace(lower(text), '[{SQL_SPACE}]+', '', 'g')) AS hash FROM t)
        SELECT hash, min(doc_id) AS doc_id, arg_min(stage, doc_id) AS stage, arg_min(tier, doc_id) AS tier,
               max(doc_id) AS last_seen FROM h GROUP BY hash""",
)
def stream_triage(t):
    """Batch twin of the continuous triage: deduplicate, decide, upsert by hash."""
    decided = cascade.triage(t.texts, LATIN)
    rows = decided.select(
        T.text_hash(F.col("text")).alias("hash"), "doc_id", "stage", "tier", F.col("doc_id").alias("last_seen")
    )
    return jobs.upsert_first_wins(rows.limit(0), rows, "hash", ["doc_id"], "last_seen", keep=["doc_id", "stage", "tier"])
