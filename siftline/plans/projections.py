"""Filters and projections over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import filters
from siftline.plans.registry import query
from siftline.plans.scans import EVENTS_NOW


@query(
    "filter_dynamic",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
)
def filter_dynamic(t):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}
    return filters.matching(t.orders, wanted).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )


@query(
    "filter_search_like",
    """SELECT p_partkey, p_name, p_type FROM part
       WHERE coalesce(p_name, '') ILIKE '%GE%' OR coalesce(p_type, '') ILIKE '%GE%'""",
)
def filter_search_like(t):
    return filters.search_any(t.part, ["p_name", "p_type"], "GE").select("p_partkey", "p_name", "p_type")


@query(
    "filter_search_text_or_direction",
    """WITH hit AS (SELECT doc_id, source FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%src1%')
       SELECT source, count(*) AS n, (SELECT count(*) FROM hit) AS total FROM hit GROUP BY source""",
)
def filter_search_text_or_direction(t):
    hits = filters.any_of(
        [F.col("text").ilike("%license%"), F.col("source").ilike("%src1%")]
    )
    per_source = t.documents.filter(hits).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = per_source.agg(F.sum("n").alias("total"))
    return per_source.select("source", "n", total.scalar().alias("total"))


@query(
    "filter_pending",
    """SELECT d.doc_id, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'seen' WHEN quality = 0 THEN '' END AS response
                  FROM labels) r ON d.doc_id = r.doc_id
       WHERE l.quality = 1 AND (r.response IS NULL OR r.response = '')""",
)
def filter_pending(t):
    response = F.when(F.col("toxic") == 1, "seen").when(F.col("quality") == 0, "")
    accepted = t.labels.filter(F.col("quality") == 1).select("doc_id", response.alias("response"))
    return (
        t.documents.select("doc_id", "source")
        .join(accepted.filter(filters.is_blank(F.col("response"))), "doc_id", "left_semi")
    )


@query(
    "filter_status_not_in",
    """SELECT event_id, event_type FROM events
       WHERE event_type IS NOT NULL AND event_type <> '' AND event_type NOT IN ('error', 'signup')""",
)
def filter_status_not_in(t):
    kind = F.col("event_type")
    return t.events.filter(~filters.is_blank(kind) & ~kind.isin("error", "signup")).select("event_id", "event_type")


@query(
    "filter_keyword_prefilter",
    """SELECT doc_id, source FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
         AND (lower(text) LIKE '%license%' OR lower(text) LIKE '%threat%' OR lower(text) LIKE '%token%')
       ORDER BY doc_id DESC""",
)
def filter_keyword_prefilter(t):
    accepted = t.labels.filter(F.col("quality") == 1)
    return (
        t.documents.filter(filters.contains_any(F.col("text"), ["license", "threat", "token"]))
        .join(accepted, "doc_id", "left_anti")
        .select("doc_id", "source")
        .orderBy(F.desc("doc_id"))
    )


@query(
    "filter_keyword_any_column",
    """SELECT p_partkey, p_name, p_type, p_brand FROM part
       WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_brand ILIKE '%ring%'
          OR p_name ILIKE '%promo%' OR p_type ILIKE '%promo%' OR p_brand ILIKE '%promo%'""",
)
def filter_keyword_any_column(t):
    return filters.tokens_in_any(t.part, ["p_name", "p_type", "p_brand"], "Ring or PROMO").select(
        "p_partkey", "p_name", "p_type", "p_brand"
    )


@query(
    "filter_lookback",
    """SELECT event_id, ts, (ts >= TIMESTAMP '2024-01-29 12:00:00') AS in_day,
              (ts >= TIMESTAMP '2024-01-23 12:00:00') AS in_week
       FROM events WHERE ts >= TIMESTAMP '2023-12-31 12:00:00'""",
)
def filter_lookback(t):
    return t.events.filter(filters.since("ts", EVENTS_NOW, "30 DAY")).select(
        "event_id",
        "ts",
        filters.since("ts", EVENTS_NOW, "1 DAY").alias("in_day"),
        filters.since("ts", EVENTS_NOW, "7 DAY").alias("in_week"),
    )


@query(
    "filter_range_inclusive_day",
    """SELECT event_id, user_id, event_type FROM events
       WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'""",
)
def filter_range_inclusive_day(t):
    return t.events.filter(filters.on_days("ts", "2024-01-10", "2024-01-12")).select(
        "event_id", "user_id", "event_type"
    )


@query(
    "filter_working_hours",
    """SELECT event_id, CAST(hour(ts + INTERVAL 3 HOUR) AS INTEGER) AS local_hour FROM events
       WHERE hour(ts + INTERVAL 3 HOUR) >= 9 AND hour(ts + INTERVAL 3 HOUR) < 19""",
)
def filter_working_hours(t):
    zone = "Europe/Moscow"
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return t.events.filter(filters.working_hours("ts", zone, 9, 19)).select(
        "event_id", F.hour(local).alias("local_hour")
    )


@query(
    "filter_archived_deleted",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE NOT coalesce(l.toxic = 1, false) AND NOT coalesce(l.quality = 0, false)""",
)
def filter_archived_deleted(t):
    flags = t.labels.select(
        "doc_id", (F.col("toxic") == 1).alias("is_deleted"), (F.col("quality") == 0).alias("is_archived")
    )
    hidden = flags.filter(F.col("is_deleted") | F.col("is_archived"))
    return t.documents.select("doc_id").join(hidden, "doc_id", "left_anti")


@query(
    "project_preview",
    r"""SELECT doc_id, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 60) || '...' ELSE flat END AS short_preview,
               CASE WHEN length(flat) > 200 THEN substr(flat, 1, 200) || '...' ELSE flat END AS long_preview
        FROM (SELECT doc_id, replace(text, chr(10), ' ') AS flat FROM documents)""",
)
def project_preview(t):
    return t.documents.select(
        "doc_id",
        filters.preview(F.col("text"), 60).alias("short_preview"),
        filters.preview(F.col("text"), 200).alias("long_preview"),
    )


@query(
    "project_short_hash",
    "SELECT doc_id, substr(coalesce(md5(text), ''), 1, 12) AS key12, substr(coalesce(md5(text), ''), 1, 8) AS key8"
    " FROM documents",
)
def project_short_hash(t):
    digest = F.md5(F.col("text"))
    return t.documents.select(
        "doc_id", filters.short_hash(digest, 12).alias("key12"), filters.short_hash(digest, 8).alias("key8")
    )


@query(
    "project_coalesce_default",
    """SELECT d.doc_id, coalesce(d.source, 'Unknown') AS source,
              coalesce(CASE l.quality WHEN 1 THEN 'HOT' WHEN 0 THEN 'COLD' END, 'NONE') AS tier
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def project_coalesce_default(t):
    tier = F.when(F.col("quality") == 1, "HOT").when(F.col("quality") == 0, "COLD")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.coalesce(tier, F.lit("NONE")).alias("tier"),
    )


@query(
    "project_label_encode",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.quality IS NOT NULL AND d.text IS NOT NULL AND d.text <> ''""",
)
def project_label_encode(t):
    return (
        t.documents.filter(~filters.is_blank(F.col("text")))
        .select("doc_id")
        .join(t.labels.filter(F.col("quality").isNotNull()), "doc_id")
        .select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(0).alias("label"))
    )


@query(
    "lookup_by_key",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_name LIKE '%0042%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""",
)
def lookup_by_key(t):
    people = t.customer.filter(F.col("c_name").contains("0042"))
    return (
        t.orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
        .limit(1)
    )


@query(
    "project_link_cleanup",
    """SELECT page_id, trim(url) AS url FROM pages
       WHERE url IS NOT NULL AND trim(url) <> '' AND lower(trim(url)) NOT IN ('url', 'link')""",
)
def project_link_cleanup(t):
    return filters.clean_links(t.pages.select("page_id", "url"), "url", ["url", "link"])
