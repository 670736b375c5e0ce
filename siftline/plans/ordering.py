"""Windows, top-k reports and set operations over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftline.functions import similarity
from siftline.operators import filters, keyed, learning, reports, search, tables as jobs
from siftline.plans.joins import by_day
from siftline.plans.registry import query
from siftline.plans.scans import EVENTS_NOW
from siftline.session import ensure_checkpoint_dir, spread


def by_turns():
    return F.floor(F.col("turn") / 1000)


@query(
    "win_latest_message",
    """SELECT user_id, event_id, ts, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
       WHERE r = 1 AND event_type <> 'error'""",
)
def win_latest_message(t):
    newest = t.events.groupBy("user_id").agg(
        F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    )
    return newest.filter(F.col("m.event_type") != "error").select("user_id", "m.event_id", "m.ts", "m.event_type")


@query(
    "win_last_n_transcript",
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS messages FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
       WHERE r <= 10 GROUP BY conv_id""",
)
def win_last_n_transcript(t):
    last = keyed.top_n_per_key(t.conversations, ["conv_id"], [F.desc("turn")], 10, ["turn"])
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return last.groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda m: m["line"]), "\n").alias("transcript"),
        reports.n().alias("messages"),
    )


@query(
    "win_latest_version",
    """SELECT conv_id, max(turn) AS version, max(turn) + 1 AS next_version, arg_max(md5(text), turn) AS content
       FROM conversations GROUP BY conv_id""",
)
def win_latest_version(t):
    versions = t.conversations.select("conv_id", F.col("turn").alias("version"), F.md5("text").alias("content"))
    latest = jobs.latest_version(versions, "conv_id", "content")
    return latest.select("conv_id", "version", (F.col("version") + 1).alias("next_version"), "content")


@query(
    "win_audit_last_n",
    """SELECT user_id, event_id, CAST(r AS INTEGER) AS rank_in_key FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
       WHERE r <= 100""",
)
def win_audit_last_n(t):
    audit = t.events.select("user_id", "event_id", "ts")
    newest = keyed.top_n_per_key(audit, ["user_id"], [F.desc("ts"), F.desc("event_id")], 100, ["event_id"])
    return newest.select("user_id", "event_id", "rank_in_key")


@query(
    "win_first_outreach",
    """SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_turn,
              arg_min(md5(text), turn) FILTER (role = 'assistant') AS first_text_key,
              coalesce(bool_or(role = 'system'), false) AS is_outreach
       FROM conversations GROUP BY conv_id""",
)
def win_first_outreach(t):
    outgoing = F.col("role") == "assistant"
    turn = F.when(outgoing, F.col("turn"))
    return t.conversations.groupBy("conv_id").agg(
        F.min(turn).alias("first_turn"),
        F.min_by(F.md5("text"), turn).alias("first_text_key"),
        F.bool_or(F.col("role") == "system").alias("is_outreach"),
    )


@query(
    "win_gap_since_prev",
    """SELECT event_id, user_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER
              (PARTITION BY user_id ORDER BY ts, event_id) / 1e6, 3) AS gap_seconds FROM events""",
)
def win_gap_since_prev(t):
    events = t.events.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    prev = keyed.previous_value(events, ["user_id"], ["ts", "event_id"], F.col("at"), by_day(), "before")
    return prev.select(
        "event_id", "user_id", F.round(F.col("at") / 1e6 - F.col("before") / 1e6, 3).alias("gap_seconds")
    )


@query(
    "win_state_change",
    """WITH s AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'DOWN' ELSE 'OK' END AS state
                  FROM events),
            l AS (SELECT *, lag(state, 1, 'OK') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
       SELECT event_id, user_id, before, state FROM l WHERE state <> before""",
)
def win_state_change(t):
    state = F.when(F.col("event_type") == "error", "DOWN").otherwise("OK")
    states = t.events.select("event_id", "user_id", "ts", state.alias("state"))
    prev = keyed.previous_value(states, ["user_id"], ["ts", "event_id"], F.col("state"), by_day(), "before")
    return (
        prev.withColumn("before", F.coalesce("before", F.lit("OK")))
        .filter(F.col("state") != F.col("before"))
        .select("event_id", "user_id", "before", "state")
    )


@query(
    "win_report_rank",
    """SELECT CAST(row_number() OVER (ORDER BY n DESC, user_id) AS INTEGER) AS position, user_id, n FROM (
         SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 50)""",
)
def win_report_rank(t):
    from pyspark.sql import Window

    top = t.events.groupBy("user_id").agg(reports.n().alias("n")).orderBy(F.desc("n"), "user_id").limit(50)
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).alias("position"), "user_id", "n"
    )


@query(
    "win_daily_cap",
    """SELECT event_id, local_day, CAST(r AS INTEGER) AS rank_in_key, CAST((r - 1) // 3 + 1 AS BIGINT) AS pass_no FROM (
         SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_day,
                row_number() OVER (PARTITION BY CAST(ts + INTERVAL 3 HOUR AS DATE)
                                   ORDER BY value DESC, ts DESC, event_id DESC) AS r
         FROM events WHERE event_type <> 'error') WHERE r <= 15""",
)
def win_daily_cap(t):
    """At most 15 a local day, three a pass, best score then newest."""
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Moscow"))
    due = t.events.filter(F.col("event_type") != "error").select("event_id", "ts", "value", local.alias("local_day"))
    best = keyed.top_n_per_key(
        due, ["local_day"], [F.desc("value"), F.desc("ts"), F.desc("event_id")], 15, ["event_id"]
    )
    return best.select(
        "event_id", "local_day", "rank_in_key", (F.floor((F.col("rank_in_key") - 1) / 3) + 1).alias("pass_no")
    )


@query(
    "win_message_index",
    """SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS message_no,
              CASE WHEN count(*) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'first'
                   WHEN count(*) OVER (PARTITION BY conv_id ORDER BY turn) <= 4 THEN 'opening'
                   WHEN count(*) OVER (PARTITION BY conv_id ORDER BY turn) <= 8 THEN 'developing'
                   ELSE 'long' END AS stage
       FROM conversations""",
)
def win_message_index(t):
    turns = t.conversations.select("conv_id", "turn")
    counted = keyed.running_sum(turns, ["conv_id"], ["turn"], F.lit(1), by_turns(), "message_no")
    number = F.col("message_no")
    stage = (
        F.when(number == 1, "first").when(number <= 4, "opening").when(number <= 8, "developing").otherwise("long")
    )
    return counted.select("conv_id", "turn", "message_no", stage.alias("stage"))


SORTABLE = ["o_orderdate", "o_totalprice", "o_custkey"]


@query(
    "sort_page_whitelist",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
       FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
def sort_page_whitelist(t):
    rows = t.orders.filter(F.col("o_orderstatus") == "F")
    total = rows.agg(reports.n().alias("n")).scalar()
    wanted = "o_totalprice"
    column = wanted if wanted in SORTABLE else SORTABLE[0]
    page = rows.orderBy(F.desc(column), "o_orderkey").offset(40).limit(20)
    return page.select("o_orderkey", "o_totalprice", total.alias("total"))


@query(
    "sort_priority_bucket",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority, o_totalprice FROM orders""",
)
def sort_priority_bucket(t):
    bucket = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM")
        .otherwise("LOW")
    )
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    return (
        t.orders.select("o_orderkey", bucket.alias("priority"), "o_totalprice")
        .orderBy(rank, F.desc("o_totalprice"), "o_orderkey")
    )


@query(
    "topk_pending",
    """SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P'
       ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 5""",
)
def topk_pending(t):
    pending = t.orders.filter(F.col("o_orderstatus") == "P")
    return (
        pending.orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey")
        .limit(5)
        .select("o_orderkey", "o_orderpriority", "o_orderdate")
    )


@query(
    "topk_recent",
    """SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' AND event_type = 'purchase'
       ORDER BY ts DESC, event_id DESC LIMIT 500""",
)
def topk_recent(t):
    recent = t.events.filter(filters.since("ts", EVENTS_NOW, "7 DAY")).filter(F.col("event_type") == "purchase")
    return recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "ts", "value")


QUESTION = "which license covers threat tokens"
_SNIPPETS = """WITH s AS (SELECT {id}, {text} AS text, lower({text}) AS low FROM {table}),
       q AS (SELECT {id}, text, low, len(list_filter(['which', 'license', 'covers', 'threat', 'tokens'],
                    lambda k: contains(low, k))) AS score FROM s),
       b AS (SELECT * FROM q WHERE score > 0 ORDER BY score DESC, {id} LIMIT 2),
       p AS (SELECT *, instr(low, 'which') - 1 AS pos FROM b)
  SELECT {id}, CAST(score AS INTEGER) AS score,
         substr(text, greatest(0, pos - 200) + 1, pos + 800 - greatest(0, pos - 200)) AS snippet FROM p"""


@query("topk_relevance_snippets", _SNIPPETS.format(id="doc_id", text="text", table="documents"))
def topk_relevance_snippets(t):
    return search.best_snippets(t.documents, "doc_id", "text", QUESTION)


@query("kb_keyword_search", _SNIPPETS.format(id="page_id", text="html", table="pages"))
def kb_keyword_search(t):
    return search.best_snippets(t.pages, "page_id", "html", QUESTION)


def _indexed(t, df, ident, text):
    index = search.build_index(spread(df), ident, text, f"{ensure_checkpoint_dir(t.spark)}/index-{uuid.uuid4().hex}")
    return search.indexed_snippets(index, df, ident, text, QUESTION)


@query("topk_indexed_snippets", _SNIPPETS.format(id="doc_id", text="text", table="documents"))
def topk_indexed_snippets(t):
    """``topk_relevance_snippets`` from an index of terms."""
    return _indexed(t, t.documents, "doc_id", "text")


@query("kb_indexed_search", _SNIPPETS.format(id="page_id", text="html", table="pages"))
def kb_indexed_search(t):
    return _indexed(t, t.pages, "page_id", "html")


_INFORMATIVENESS = """
  p AS (SELECT event_id, event_type, value / 500.0 AS p1, json_extract(props, '$.k')::DOUBLE / 100.0 AS p2 FROM events),
  c AS (SELECT *, greatest(1e-10, least(1 - 1e-10, p1)) AS q1, greatest(1e-10, least(1 - 1e-10, p2)) AS q2 FROM p),
  i AS (SELECT event_id, event_type, round(0.25 * (1 - greatest(p1, p2))
               + 0.35 * (1 - 2 * least(abs(p1 - 0.5), abs(p2 - 0.5)))
               + 0.20 * ((-(q1 * log2(q1) + (1 - q1) * log2(1 - q1)) - (q2 * log2(q2) + (1 - q2) * log2(1 - q2))) / 2)
               + 0.20 * (((p1 - p2) / 2) * ((p1 - p2) / 2)), 6) AS informativeness FROM c)"""


@query(
    "topk_informative",
    f"""WITH {_INFORMATIVENESS}
        SELECT event_id, informativeness FROM (
          SELECT * FROM i WHERE event_type = 'click')
        ORDER BY informativeness DESC, event_id LIMIT 50""",
)
def topk_informative(t):
    """Clicks stand in for the WARM tier."""
    scored = learning.informativeness(event_scores(t), "event_id", ["event_type"])
    return learning.select_batch(scored, F.col("event_type") == "click", "event_id").select(
        "event_id", "informativeness"
    )


def event_scores(t):
    scores = F.array(F.col("value") / 500.0, F.get_json_object("props", "$.k").cast("double") / 100.0)
    return t.events.select("event_id", "event_type", scores.alias("scores"))


@query(
    "topk_sources",
    """SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'
       GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5""",
)
def topk_sources(t):
    return reports.by_group(t.events.filter(filters.on_days("ts", "2024-01-15", "2024-01-15")), "user_id", top=5)


@query(
    "top_queue_oldest",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'
       ORDER BY o_orderdate, o_orderkey LIMIT 20""",
)
def top_queue_oldest(t):
    return (
        t.orders.filter(F.col("o_orderstatus") == "P").orderBy("o_orderdate", "o_orderkey").limit(20)
        .select("o_orderkey", "o_orderdate")
    )


@query("sort_multi_key", "SELECT p_type, p_name, p_partkey, p_size FROM part")
def sort_multi_key(t):
    return t.part.select("p_type", "p_name", "p_partkey", "p_size").orderBy("p_type", F.desc("p_size"), "p_partkey")


@query(
    "set_union_backfill",
    """WITH today AS (SELECT text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1),
            older AS (SELECT text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1)
       SELECT DISTINCT md5(text) AS text_key FROM (
         SELECT text FROM today UNION ALL
         SELECT text FROM older)""",
)
def set_union_backfill(t):
    """Today's rows and the older ones, each text once."""
    docs = t.documents.select("doc_id", "text")
    today = docs.join(t.labels.filter(F.col("toxic") == 1), "doc_id", "left_semi").select("text")
    older = docs.join(t.labels.filter(F.col("quality") == 1), "doc_id", "left_semi").select("text")
    return today.union(older).select(F.md5("text").alias("text_key")).distinct()


@query(
    "set_rules_merge_new",
    """WITH have AS (SELECT DISTINCT lower(trim(p_type)) AS rule FROM part),
            fresh AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS rule FROM customer
                      UNION SELECT DISTINCT lower(trim(p_type)) FROM part),
            added AS (SELECT rule FROM fresh EXCEPT SELECT rule FROM have)
       SELECT rule, false AS is_new, (SELECT count(*) FROM added) AS added FROM have
       UNION ALL SELECT rule, true, (SELECT count(*) FROM added) FROM added""",
)
def set_rules_merge_new(t):
    have = t.part.select(F.lower(F.trim("p_type")).alias("rule")).distinct()
    offered = t.customer.select(F.lower(F.trim("c_mktsegment")).alias("rule")).union(have).distinct()
    added = jobs.missing_rows(offered.filter(F.col("rule") != ""), have, ["rule"])
    count = added.agg(reports.n().alias("n")).scalar()
    merged = have.withColumn("is_new", F.lit(False)).union(added.withColumn("is_new", F.lit(True)))
    return merged.select("rule", "is_new", count.alias("added"))


@query(
    "set_blacklist_bulk",
    """SELECT DISTINCT trim(p_name) AS item FROM part WHERE trim(p_name) <> ''
       EXCEPT SELECT DISTINCT trim(p_name) FROM part WHERE p_size > 49""",
)
def set_blacklist_bulk(t):
    listed = t.part.select(F.trim("p_name").alias("item")).filter(F.col("item") != "").dropDuplicates()
    removed = t.part.filter(F.col("p_size") > 49).select(F.trim("p_name").alias("item")).distinct()
    return jobs.delete_keys(listed, removed, "item")


@query(
    "set_array_intersect",
    """SELECT p_partkey, CAST(len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'gear', 'bolt'])) AS INTEGER)
                AS hits,
              round(len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'gear', 'bolt'])) / 4.0, 4)::DOUBLE
                AS share
       FROM part""",
)
def set_array_intersect(t):
    wanted = F.array(*map(F.lit, ["red", "ring", "gear", "bolt"]))
    hits = F.size(F.array_intersect(F.split("p_name", " "), wanted))
    return t.part.select("p_partkey", hits.alias("hits"), F.round(hits / 4.0, 4).alias("share"))


_SHINGLES = r"""list_distinct(list_transform(generate_series(1, length({c}) - 2), lambda i: substr({c}, i::BIGINT, 3)))"""


@query(
    "set_shingles",
    f"""WITH c AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g') AS a,
                          regexp_replace(lower(p_brand || p_type), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g') AS b FROM part),
             s AS (SELECT p_partkey, {_SHINGLES.format(c="a")} AS sa, {_SHINGLES.format(c="b")} AS sb FROM c)
        SELECT p_partkey, CAST(len(sa) AS INTEGER) AS shingles,
               CAST(len(list_intersect(sa, sb)) AS INTEGER) AS common,
               CAST(len(list_distinct(list_concat(sa, sb))) AS INTEGER) AS either FROM s""",
)
def set_shingles(t):
    a = similarity.shingles(F.col("p_name"))
    b = similarity.shingles(F.concat("p_brand", "p_type"))
    return t.part.select("p_partkey", a.alias("a"), b.alias("b")).select(
        "p_partkey",
        F.size("a").alias("shingles"),
        F.size(F.array_intersect("a", "b")).alias("common"),
        F.size(F.array_union("a", "b")).alias("either"),
    )
