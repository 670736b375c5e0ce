"""Scans, sinks and export shapes over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import filters, keyed, tables as jobs
from siftline.plans.registry import query

EVENTS_NOW = "2024-01-30 12:00:00"
ORDERS_NOW = "2001-07-31 00:00:00"


@query("scan_messages", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_messages(t):
    return t.documents


@query(
    "scan_recent_window",
    """SELECT event_id, event_type, ts, CAST(rank_in_key AS INTEGER) AS rank_in_key FROM (
         SELECT event_id, event_type, ts,
                row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank_in_key
         FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00')
       WHERE rank_in_key <= 100""",
)
def scan_recent_window(t):
    recent = t.events.filter(filters.since("ts", EVENTS_NOW, "24 HOUR")).filter(
        F.col("ts") <= F.expr(f"TIMESTAMP_NTZ '{EVENTS_NOW}'")
    )
    return keyed.top_n_per_key(
        recent.select("event_id", "event_type", "ts"),
        ["event_type"],
        [F.desc("ts"), F.desc("event_id")],
        100,
        ["event_id"],
    )


@query(
    "scan_backfill",
    """SELECT event_id, user_id, event_type, props FROM events
       WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND props IS NOT NULL AND props <> ''""",
)
def scan_backfill(t):
    return (
        t.events.filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
        .filter(~filters.is_blank(F.col("props")))
        .select("event_id", "user_id", "event_type", "props")
    )


@query(
    "sink_upsert",
    r"""WITH hashed AS (
          SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS stored,
                 md5(regexp_replace(lower(d.text), '\s', '', 'g')) AS hash
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        SELECT hash, arg_min(doc_id, (CASE WHEN stored THEN 0 ELSE 1 END, doc_id)) AS doc_id,
               arg_min(source, (CASE WHEN stored THEN 0 ELSE 1 END, doc_id)) AS source,
               max(doc_id) AS last_seen
        FROM hashed GROUP BY hash""",
)
def sink_upsert(t):
    """Labelled documents are the stored rows, the others arrive."""
    rows = t.documents.select(
        T.text_hash(F.col("text")).alias("hash"), "doc_id", "source", F.col("doc_id").alias("last_seen")
    )
    labels = t.labels.select("doc_id")
    stored, incoming = rows.join(labels, "doc_id", "left_semi"), rows.join(labels, "doc_id", "left_anti")
    return jobs.upsert_first_wins(stored, incoming, "hash", ["doc_id"], "last_seen", keep=["doc_id", "source"])


@query(
    "sink_csv_export",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, n_name AS region,
              round(c_acctbal, 2) AS balance
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0""",
)
def sink_csv_export(t):
    people = t.customer.filter(F.col("c_acctbal") > 0).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return people.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("region"),
        F.round("c_acctbal", 2).alias("balance"),
    )


@query(
    "sink_json_dump",
    """SELECT CAST(coalesce(quality, 0) = 1 AS BOOLEAN) AS is_relevant,
              '{"doc_id":' || d.doc_id || ',"source":"' || d.source || '","lang":"' || d.lang || '"}' AS value
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def sink_json_dump(t):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_relevant"),
        F.to_json(F.struct("doc_id", "source", "lang")).alias("value"),
    )


@query(
    "sink_report_lines",
    """SELECT o_orderpriority || ': ' || count(*) || ' total, '
              || count(*) FILTER (o_orderstatus = 'F') || ' accepted, '
              || count(*) FILTER (o_orderstatus = 'O') || ' rejected' AS line
       FROM orders GROUP BY o_orderpriority""",
)
def sink_report_lines(t):
    counts = t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("accepted"),
        F.count_if(F.col("o_orderstatus") == "O").alias("rejected"),
    )
    return counts.select(
        F.format_string("%s: %d total, %d accepted, %d rejected", "o_orderpriority", "n", "accepted", "rejected").alias(
            "line"
        )
    )


@query(
    "export_topic_first",
    """SELECT doc_id, source, (coalesce(regexp_matches(lower(text), 'license|token'), false)
              OR source = 'src3') AS on_topic
       FROM documents""",
)
def export_topic_first(t):
    topic = F.coalesce(F.col("text").rlike("(?iu)license|token"), F.lit(False)) | F.coalesce(
        F.col("source").rlike("(?iu)^src3$"), F.lit(False)
    )
    return (
        t.documents.select("doc_id", "source", topic.alias("on_topic"))
        .orderBy(F.desc("on_topic"), F.desc("doc_id"))
    )


@query(
    "seed_if_empty",
    """SELECT n_nationkey AS id, n_name AS name FROM nation
       WHERE n_nationkey NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 0)""",
)
def seed_if_empty(t):
    """Seed rows enter only where the target has no row with that key."""
    target = t.supplier.filter(F.col("s_acctbal") < 0).select(F.col("s_nationkey").alias("id"))
    seed = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return jobs.missing_rows(seed, target, ["id"])


@query(
    "source_log_text",
    """SELECT event_type, count(*) AS lines, CAST(sum(length(strftime(ts, '%Y-%m-%d %H:%M:%S')
              || ' | ' || event_type || ' | user ' || user_id)) AS BIGINT) AS characters
       FROM events GROUP BY event_type""",
)
def source_log_text(t):
    """Events rendered as log lines and parsed back by field."""
    lines = t.events.select(
        F.format_string(
            "%s | %s | user %d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", "user_id"
        ).alias("value")
    )
    return (
        lines.groupBy(F.split_part("value", F.lit(" | "), F.lit(2)).alias("event_type"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value").cast("long")).alias("characters"))
    )
