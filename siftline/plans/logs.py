"""Log analytics and text search over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import logs, search
from siftline.plans.registry import query


def scan_log(t):
    """A progress log derived from the events: a user is a chat, its events are its log lines."""
    kind, value = F.col("event_type"), F.round("value").cast("long")
    line = (
        F.when(kind == "view", F.format_string("[%d] ⏳ chat %d: processed %d msgs...", "user_id", "user_id", value))
        .when(kind == "click", F.format_string("[%d] ⏳ room %d: processed %d msgs...", "user_id", "user_id", value))
        .when(kind == "purchase", F.format_string("[%d] ✅ DONE: chat %d (%d msgs)", "user_id", "user_id", value))
        .when(kind == "signup", F.format_string("[%d] ⚪ EMPTY: chat %d", "user_id", "user_id"))
        .otherwise(F.format_string("   ✅ Найдено! Score: 4, Spec: S%d", F.floor(F.col("value") / 10)))
    )
    return t.events.select(F.col("event_id").alias("line_no"), line.alias("value"))


@query(
    "log_progress_parse",
    """SELECT event_id AS line_no,
              CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'done'
                   WHEN 'signup' THEN 'empty' ELSE 'lead' END AS kind,
              CASE WHEN event_type <> 'error' THEN user_id END AS chat_index,
              CASE event_type WHEN 'click' THEN 'room ' || user_id WHEN 'view' THEN 'chat ' || user_id
                   WHEN 'purchase' THEN 'chat ' || user_id END AS name,
              CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CAST(round(value) AS BIGINT) END AS messages,
              CASE WHEN event_type = 'error' THEN 'S' || CAST(floor(value / 10) AS BIGINT) END AS specialisation
       FROM events""",
)
def log_progress_parse(t):
    return logs.parse(scan_log(t)).select("line_no", "kind", "chat_index", "name", "messages", "specialisation")


@query(
    "log_progress_totals",
    """WITH c AS (SELECT user_id, arg_max(event_type, event_id) AS last_kind,
                         count(*) FILTER (event_type IN ('purchase', 'signup')) AS finished,
                         sum(CAST(round(value) AS BIGINT)) FILTER (event_type = 'purchase') AS done,
                         arg_max(CAST(round(value) AS BIGINT), event_id) FILTER (event_type IN ('view', 'click', 'purchase'))
                           AS latest
                  FROM events WHERE event_type <> 'error' GROUP BY 1),
            s AS (SELECT *, coalesce(done, 0)
                         + CASE WHEN last_kind IN ('view', 'click') THEN latest ELSE 0 END AS scanned FROM c)
       SELECT CAST(sum(finished) AS BIGINT) AS chats_done, CAST(sum(scanned) AS BIGINT) AS scanned,
              count(*) FILTER (last_kind IN ('view', 'click')) AS active,
              round(sum(scanned) * 100.0 / 2600000, 4)::DOUBLE AS percent FROM s""",
)
def log_progress_totals(t):
    return logs.totals(logs.parse(scan_log(t)), "line_no", 2_600_000)


@query(
    "log_join_counts",
    """SELECT count(*) FILTER (event_type = 'purchase') AS joined,
              count(*) FILTER (event_type = 'signup') AS already_member FROM events""",
)
def log_join_counts(t):
    return logs.join_counts(scan_log(t), "✅ DONE", "⚪ EMPTY")


@query(
    "grep_with_context",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
            e AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS line_no FROM l)
       SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lines[line_no] AS line,
              array_to_string(list_slice(lines, greatest(1, line_no - 1), line_no + 1), chr(10)) AS context
       FROM e WHERE contains(lower(lines[line_no]), 'license')""",
)
def grep_with_context(t):
    return search.grep(t.documents, "doc_id", "text", "License", context=1)


@query(
    "corpus_file_stats",
    """SELECT source, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines,
              CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(doc_id) AS last_modified
       FROM documents GROUP BY source""",
)
def corpus_file_stats(t):
    return search.corpus_stats(t.documents, "source", "text", "doc_id")
