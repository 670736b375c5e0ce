"""Reports over the driver tables (orders, events and conversations stand in for leads, logs and dialogs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import filters, reports
from siftline.plans.registry import query
from siftline.plans.scans import EVENTS_NOW
from siftline.operators.reports import n


def _accepted():
    return F.col("o_orderstatus") == "F"


def _rejected():
    return F.col("o_orderstatus") == "O"


@query(
    "agg_status_counts",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS accepted,
              count(*) FILTER (o_orderstatus = 'O') AS rejected FROM orders""",
)
def agg_status_counts(t):
    return t.orders.agg(n().alias("total"), *reports.counts({"accepted": _accepted(), "rejected": _rejected()}))


@query(
    "agg_by_status",
    """SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 12:00:00') AS n_last_day
       FROM events GROUP BY event_type""",
)
def agg_by_status(t):
    last_day = filters.since("ts", EVENTS_NOW, "24 HOUR")
    return t.events.groupBy("event_type").agg(n().alias("n"), F.count_if(last_day).alias("n_last_day"))


@query(
    "agg_overview",
    """SELECT count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS hot,
              count(*) FILTER (o_orderpriority IN ('2-HIGH', '3-MEDIUM')) AS warm,
              count(*) FILTER (o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS cold,
              count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS rejected,
              count(*) FILTER (o_totalprice > 300000) AS large,
              CASE WHEN count(*) = 0 THEN 0.0
                   ELSE round(count(*) FILTER (o_orderpriority = '1-URGENT') * 100.0 / count(*), 1)::DOUBLE END
                AS conversion_rate
       FROM orders WHERE o_orderdate >= TIMESTAMP '2000-08-01 00:00:00'""",
)
def agg_overview(t):
    tier = F.col("o_orderpriority")
    counted = t.orders.filter(F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '2000-08-01'")).agg(
        n().alias("total"),
        *reports.counts(
            {
                "hot": tier == "1-URGENT",
                "warm": tier.isin("2-HIGH", "3-MEDIUM"),
                "cold": tier.isin("4-NOT SPECIFIED", "5-LOW"),
                "accepted": _accepted(),
                "rejected": _rejected(),
                "large": F.col("o_totalprice") > 300000,
            }
        ),
    )
    return counted.withColumn("conversion_rate", reports.percent(F.col("hot"), F.col("total")))


@query(
    "agg_by_niche",
    """SELECT coalesce(p_type, 'Unknown') AS p_type, count(*) AS n FROM part GROUP BY 1
       ORDER BY n DESC, p_type LIMIT 20""",
)
def agg_by_niche(t):
    return reports.by_group(t.part, "p_type", top=20, default="Unknown")


@query(
    "agg_by_source",
    """SELECT coalesce(source, 'Unknown') AS source, count(*) AS n FROM documents GROUP BY 1
       ORDER BY n DESC, source LIMIT 20""",
)
def agg_by_source(t):
    return reports.by_group(t.documents, "source", top=20, default="Unknown")


@query(
    "agg_timeline",
    """SELECT 'hour' AS step, strftime(ts, '%Y-%m-%d %H:00') AS bucket, count(*) AS n FROM events
       WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 2
       UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events
       WHERE ts >= TIMESTAMP '2023-12-31 12:00:00' GROUP BY 2""",
)
def agg_timeline(t):
    hours = reports.timeline(t.events.filter(filters.since("ts", EVENTS_NOW, "24 HOUR")), "ts", "yyyy-MM-dd HH:00")
    days = reports.timeline(t.events.filter(filters.since("ts", EVENTS_NOW, "30 DAY")), "ts", "yyyy-MM-dd")
    return hours.select(F.lit("hour").alias("step"), "bucket", "n").union(
        days.select(F.lit("day").alias("step"), "bucket", "n")
    )


@query(
    "agg_hourly_load",
    """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS total, count(*) FILTER (event_type = 'error') AS manual,
              count(*) - count(*) FILTER (event_type = 'error') AS auto
       FROM events WHERE event_type <> 'view' GROUP BY 1""",
)
def agg_hourly_load(t):
    return (
        t.events.filter(F.col("event_type") != "view")
        .groupBy(F.hour("ts").alias("hour"))
        .agg(n().alias("total"), *reports.counts({"manual": F.col("event_type") == "error"}))
        .withColumn("auto", F.col("total") - F.col("manual"))
    )


@query(
    "agg_tier_stage",
    """SELECT o_orderpriority AS tier, o_orderstatus AS stage, count(*) AS n,
              count(*) FILTER (o_totalprice < 50000) AS archived
       FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))""",
)
def agg_tier_stage(t):
    named = t.orders.select(
        F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("stage"), "o_totalprice"
    )
    return named.groupingSets([[F.col("tier")], [F.col("stage")]], F.col("tier"), F.col("stage")).agg(
        n().alias("n"), F.count_if(F.col("o_totalprice") < 50000).alias("archived")
    )


@query(
    "agg_daily_report",
    """WITH d AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'),
            c AS (SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS accepted,
                         count(*) FILTER (event_type = 'error') AS rejected,
                         count(*) FILTER (event_type = 'purchase') AS sent FROM d),
            s AS (SELECT user_id, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5)
       SELECT c.*, round(accepted * 100.0 / greatest(total, 1), 1)::DOUBLE AS acceptance_rate,
              round(sent * 100.0 / greatest(accepted, 1), 1)::DOUBLE AS response_rate,
              (SELECT string_agg(user_id || ':' || n, ',' ORDER BY n DESC, user_id) FROM s) AS top_sources
       FROM c""",
)
def agg_daily_report(t):
    day = t.events.filter(filters.on_days("ts", "2024-01-15", "2024-01-15"))
    totals = day.agg(
        n().alias("total"),
        *reports.counts(
            {
                "accepted": F.col("event_type") != "error",
                "rejected": F.col("event_type") == "error",
                "sent": F.col("event_type") == "purchase",
            }
        ),
    )
    top = day.groupBy("user_id").agg(n().alias("n")).orderBy(F.desc("n"), "user_id").limit(5)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "user_id")))
    line = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["user_id"], -s["k"])), ",")
    return totals.select(
        "*",
        reports.percent(F.col("accepted"), F.greatest("total", F.lit(1))).alias("acceptance_rate"),
        reports.percent(F.col("sent"), F.greatest("accepted", F.lit(1))).alias("response_rate"),
        top.agg(line.alias("top_sources")).scalar().alias("top_sources"),
    )


@query(
    "agg_weekly_report",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total,
                         count(*) FILTER (event_type = 'purchase') AS accepted
                  FROM events WHERE ts >= TIMESTAMP '2024-01-27' GROUP BY 1),
            c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE)
                    AS day)
       SELECT c.day, coalesce(total, 0) AS total, coalesce(accepted, 0) AS accepted,
              round((SELECT sum(total) FROM d) / 7.0, 1)::DOUBLE AS average_per_day
       FROM c LEFT JOIN d ON c.day = d.day""",
)
def agg_weekly_report(t):
    accepted = F.col("event_type") == "purchase"
    days = reports.dense_days(
        t.events, "ts", "2024-01-27", "2024-02-02", [n().alias("total"), F.count_if(accepted).alias("accepted")]
    )
    average = days.agg(F.round(F.sum("total") / 7.0, 1).alias("a")).scalar()
    return days.withColumn("average_per_day", average)


@query(
    "agg_morning_report",
    """SELECT count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'purchase') AS sent,
              count(*) FILTER (event_type = 'view' AND value > 50) AS pending,
              count(*) FILTER (event_type = 'view' AND value <= 1) AS without_contact,
              count(*) FILTER (event_type = 'signup') AS incoming,
              (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id) FROM (
                 SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'
                 AND event_type = 'view' ORDER BY value DESC, event_id LIMIT 5)) AS top_pending
       FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'""",
)
def agg_morning_report(t):
    recent = t.events.filter(filters.since("ts", EVENTS_NOW, "24 HOUR"))
    kind, value = F.col("event_type"), F.col("value")
    top = recent.filter(kind == "view").orderBy(F.desc("value"), "event_id").limit(5)
    ids = F.transform(
        F.array_sort(F.collect_list(F.struct((-value).alias("k"), "event_id"))), lambda s: s["event_id"].cast("string")
    )
    return recent.agg(
        *reports.counts(
            {
                "accepted": kind != "error",
                "sent": kind == "purchase",
                "pending": (kind == "view") & (value > 50),
                "without_contact": (kind == "view") & (value <= 1),
                "incoming": kind == "signup",
            }
        )
    ).withColumn("top_pending", top.agg(F.array_join(ids, ",").alias("ids")).scalar())


@query(
    "agg_period_trend",
    """WITH c AS (SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-23 12:00:00') AS current,
                         count(*) FILTER (ts < TIMESTAMP '2024-01-23 12:00:00') AS previous
                  FROM events WHERE ts >= TIMESTAMP '2024-01-16 12:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00'),
            p AS (SELECT *, CASE WHEN previous = 0 THEN CASE WHEN current > 0 THEN 100.0 ELSE 0.0 END
                         ELSE (current - previous) * 100.0 / previous END AS change FROM c)
       SELECT current, previous, CASE WHEN change >= 0 THEN 'up' ELSE 'down' END AS direction,
              round(abs(change), 1)::DOUBLE AS change_percent FROM p""",
)
def agg_period_trend(t):
    return reports.period_trend(t.events, "ts", EVENTS_NOW, 7)


@query(
    "agg_dashboard_metrics",
    """SELECT count(*) AS total, count(*) FILTER (c_acctbal >= 7000) AS hot,
              count(*) FILTER (c_acctbal >= 4000 AND c_acctbal < 7000) AS warm,
              count(*) FILTER (c_acctbal < 4000) AS cold, count(*) FILTER (last_order >= TIMESTAMP '2001-07-30') AS active,
              count(*) FILTER (orders_won > 5) AS meetings,
              round(count(*) FILTER (orders_won > 5) * 100.0 / greatest(count(*), 1), 2)::DOUBLE AS conversion
       FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order,
              count(*) FILTER (o_orderstatus = 'F') AS orders_won FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def agg_dashboard_metrics(t):
    activity = t.orders.groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last_order"), F.count_if(_accepted()).alias("orders_won")
    )
    balance = F.col("c_acctbal")
    totals = t.customer.join(activity, F.col("c_custkey") == F.col("o_custkey"), "left").agg(
        n().alias("total"),
        *reports.counts(
            {
                "hot": balance >= 7000,
                "warm": (balance >= 4000) & (balance < 7000),
                "cold": balance < 4000,
                "active": F.col("last_order") >= F.expr("TIMESTAMP_NTZ '2001-07-30'"),
                "meetings": F.col("orders_won") > 5,
            }
        ),
    )
    return totals.withColumn("conversion", reports.percent(F.col("meetings"), F.greatest("total", F.lit(1)), 2))


@query(
    "agg_acceptance_rate",
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS rejected,
              round(count(*) FILTER (o_orderstatus = 'F') * 100.0
                    / greatest(count(*) FILTER (o_orderstatus IN ('F', 'O')), 1), 1)::DOUBLE AS acceptance_rate,
              count(*) FILTER (o_orderstatus = 'P') AS queued,
              count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') AS stuck,
              count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS without_contact
       FROM orders""",
)
def agg_acceptance_rate(t):
    pending = F.col("o_orderstatus") == "P"
    totals = t.orders.agg(
        *reports.counts(
            {
                "accepted": _accepted(),
                "rejected": _rejected(),
                "queued": pending,
                "stuck": pending & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-01-01'")),
                "without_contact": _accepted() & (F.col("o_orderpriority") == "5-LOW"),
            }
        )
    )
    decided = F.greatest(F.col("accepted") + F.col("rejected"), F.lit(1))
    return totals.withColumn("acceptance_rate", reports.percent(F.col("accepted"), decided))


@query(
    "agg_channel_status_today",
    """SELECT count(*) FILTER (event_type = 'signup') AS incoming, count(*) FILTER (event_type = 'purchase') AS outgoing,
              count(*) FILTER (event_type = 'click') AS outgoing_offers, count(*) FILTER (event_type = 'error') AS failed,
              max(ts) AS last_run, arg_max(event_type, (ts, event_id)) AS last_kind,
              round(count(*) FILTER (event_type <> 'error') * 100.0 / greatest(count(*), 1), 1)::DOUBLE AS success_rate
       FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31'""",
)
def agg_channel_status_today(t):
    kind = F.col("event_type")
    today = t.events.filter(filters.on_days("ts", "2024-01-30", "2024-01-30")).agg(
        *reports.counts(
            {
                "incoming": kind == "signup",
                "outgoing": kind == "purchase",
                "outgoing_offers": kind == "click",
                "failed": kind == "error",
            }
        ),
        F.max("ts").alias("last_run"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"),
        n().alias("_total"),
    )
    ok = F.col("_total") - F.col("failed")
    return today.withColumn("success_rate", reports.percent(ok, F.greatest("_total", F.lit(1)))).drop("_total")


@query(
    "agg_strategy_report",
    """WITH s AS (SELECT event_type AS strategy, count(*) AS attempts, count(*) FILTER (value > 50) AS successes,
                         round(avg(value), 6) AS average_reward FROM events GROUP BY 1)
       SELECT strategy, attempts, successes, round(successes * 100.0 / attempts, 1)::DOUBLE AS success_rate,
              average_reward, round((1.0 + successes) / (2.0 + attempts), 6)::DOUBLE AS posterior_mean,
              strategy = (SELECT arg_max(strategy, (average_reward, strategy)) FROM s WHERE attempts > 10) AS is_best
       FROM s""",
)
def agg_strategy_report(t):
    stats = t.events.groupBy(F.col("event_type").alias("strategy")).agg(
        n().alias("attempts"),
        F.count_if(F.col("value") > 50).alias("successes"),
        F.round(F.avg("value"), 6).alias("average_reward"),
    )
    best = stats.filter(F.col("attempts") > 10).agg(
        F.max_by("strategy", F.struct("average_reward", "strategy")).alias("s")
    )
    return stats.select(
        "strategy",
        "attempts",
        "successes",
        reports.percent(F.col("successes"), F.col("attempts")).alias("success_rate"),
        "average_reward",
        F.round((F.col("successes") + 1.0) / (F.col("attempts") + 2.0), 6).alias("posterior_mean"),
        (F.col("strategy") == best.scalar()).alias("is_best"),
    )


@query(
    "agg_hourly_tier_stats",
    """SELECT date_trunc('hour', ts) AS hour_start, count(*) AS total, count(*) FILTER (value >= 70) AS hot,
              count(*) FILTER (value >= 50 AND value < 70) AS warm, count(*) FILTER (value < 50) AS cold,
              round(avg(value), 4) AS average_ms
       FROM events GROUP BY 1""",
)
def agg_hourly_tier_stats(t):
    value = F.col("value")
    return (
        t.events.groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(
            n().alias("total"),
            *reports.counts({"hot": value >= 70, "warm": (value >= 50) & (value < 70), "cold": value < 50}),
            F.round(F.avg("value"), 4).alias("average_ms"),
        )
        .select(F.col("w.start").alias("hour_start"), "total", "hot", "warm", "cold", "average_ms")
    )


@query(
    "agg_block_allow",
    """SELECT count(*) FILTER (toxic = 1) AS blocked, count(*) FILTER (toxic = 0) AS allowed, count(*) AS total
       FROM labels""",
)
def agg_block_allow(t):
    toxic = F.col("toxic")
    return t.labels.agg(*reports.counts({"blocked": toxic == 1, "allowed": toxic == 0}), n().alias("total"))


@query(
    "agg_wait_stats",
    """SELECT event_type, round(count(*) FILTER (value > 30) * 100.0 / count(*), 2)::DOUBLE AS rejected_percent,
              coalesce(round(avg(CASE WHEN value > 30 THEN value END), 6), 0.0) AS mean_wait
       FROM events GROUP BY 1""",
)
def agg_wait_stats(t):
    over = F.col("value") > 30
    return t.events.groupBy("event_type").agg(
        reports.percent(F.count_if(over), n(), 2).alias("rejected_percent"),
        F.coalesce(F.round(F.avg(F.when(over, F.col("value"))), 6), F.lit(0.0)).alias("mean_wait"),
    )


@query(
    "agg_array_mean",
    r"""SELECT doc_id, printf('%.9e', coalesce(list_avg(list_transform(
                 regexp_extract_all(lower(text), '(\d+)', 1), lambda s: CAST(s AS DOUBLE))), 0.0))::DOUBLE AS mean_number
        FROM documents""",
)
def agg_array_mean(t):
    values = F.transform(T.extract_all(F.lower("text"), r"(\d+)", 1), lambda s: s.cast("double"))
    mean = F.format_string("%.9e", T.array_mean(values)).cast("double")  # ten digits: sums of doubles differ in the last ones
    return t.documents.select("doc_id", mean.alias("mean_number"))


@query(
    "agg_committee",
    """WITH p AS (SELECT event_id, value / 500.0 AS p1, (json_extract(props, '$.k')::DOUBLE) / 100.0 AS p2 FROM events)
       SELECT event_id, round(greatest(p1, p2), 6) AS top, round(least(abs(p1 - 0.5), abs(p2 - 0.5)), 6) AS margin,
              round(((p1 - p2) / 2.0) * ((p1 - p2) / 2.0), 6) AS variance
       FROM p""",
)
def agg_committee(t):
    from siftline.operators import learning

    scores = F.array(F.col("value") / 500.0, F.get_json_object("props", "$.k").cast("double") / 100.0)
    return t.events.select("event_id", learning.committee(scores).alias("c")).select(
        "event_id",
        F.round("c.top", 6).alias("top"),
        F.round("c.margin", 6).alias("margin"),
        F.round("c.variance", 6).alias("variance"),
    )


@query("agg_distinct_texts", "SELECT text, count(*) AS copies FROM documents GROUP BY text")
def agg_distinct_texts(t):
    """Distinct texts; copies are combined before the shuffle."""
    return t.documents.groupBy("text").agg(n().alias("copies"))


@query(
    "agg_label_progress",
    """SELECT count(l.quality) AS labelled, count(*) - count(l.quality) AS unlabelled,
              round(avg(CASE WHEN l.quality IS NULL THEN length(d.text) END), 4) AS mean_length
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def agg_label_progress(t):
    return t.documents.select("doc_id", F.length("text").alias("size")).join(t.labels, "doc_id", "left").agg(
        F.count("quality").alias("labelled"),
        (n() - F.count("quality")).alias("unlabelled"),
        F.round(F.avg(F.when(F.col("quality").isNull(), F.col("size"))), 4).alias("mean_length"),
    )


@query("agg_specialisation_counts", "SELECT label AS specialisation, count(*) AS n FROM embeddings GROUP BY 1")
def agg_specialisation_counts(t):
    return t.embeddings.groupBy(F.col("label").alias("specialisation")).agg(n().alias("n"))


@query(
    "agg_legacy_stats",
    """SELECT count(*) AS total, count(*) FILTER (value > 100) AS hot,
              count(*) FILTER (ts >= TIMESTAMP '2024-01-29 12:00:00') AS last_day,
              count(*) FILTER (event_type = 'purchase') AS sent, 0.0::DOUBLE AS reply_rate FROM events""",
)
def agg_legacy_stats(t):
    return t.events.agg(
        n().alias("total"),
        *reports.counts(
            {
                "hot": F.col("value") > 100,
                "last_day": filters.since("ts", EVENTS_NOW, "24 HOUR"),
                "sent": F.col("event_type") == "purchase",
            }
        ),
        F.lit(0.0).alias("reply_rate"),
    )
