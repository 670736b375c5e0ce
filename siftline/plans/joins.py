"""Join operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import similarity, text as T
from siftline.operators import joins, keyed
from siftline.plans.registry import query
from siftline.plans.text_functions import SQL_SPACE


def by_day():
    return F.date_trunc("day", F.col("ts"))


@query(
    "join_dialog_lead_left",
    """SELECT o_orderkey, o_orderdate, o_orderstatus, c_name, c_mktsegment
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100""",
)
def join_dialog_lead_left(t):
    page = (
        t.orders.filter(F.col("o_orderstatus") == "P")
        .orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
        .offset(100)
        .limit(50)
    )
    return page.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "c_name", "c_mktsegment"
    )


@query(
    "join_lead_messages",
    """SELECT c_custkey, c_name, o_orderkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def join_lead_messages(t):
    return (
        t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
        .select("c_custkey", "c_name", "o_orderkey", "o_orderdate")
        .orderBy("c_custkey", "o_orderdate", "o_orderkey")
    )


WORDS_SQL = "list_distinct(regexp_extract_all(lower({}), '[^" + SQL_SPACE.replace("{", "{{").replace("}", "}}") + "]+'))"
SHARED_SQL = "round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)"


@query(
    "join_hash_then_prefix",
    rf"""WITH l AS (SELECT d.doc_id, d.text FROM documents d SEMI JOIN labels x ON d.doc_id = x.doc_id),
             r AS (SELECT d.doc_id, d.text FROM documents d ANTI JOIN labels x ON d.doc_id = x.doc_id),
             h AS (SELECT md5(regexp_replace(lower(text), '\s', '', 'g')) AS hash, min(doc_id) AS hit
                   FROM r GROUP BY 1),
             e AS (SELECT l.doc_id, l.text, h.hit
                   FROM l LEFT JOIN h ON md5(regexp_replace(lower(l.text), '\s', '', 'g')) = h.hash),
             p AS (SELECT e.doc_id, min(r.doc_id) AS hit
                   FROM e JOIN r ON starts_with(r.text, substr(e.text, 1, 100)) WHERE e.hit IS NULL GROUP BY 1),
             w AS (SELECT p.doc_id, {WORDS_SQL.format("e.text")} AS a, {WORDS_SQL.format("r.text")} AS b
                   FROM p JOIN e ON e.doc_id = p.doc_id JOIN r ON r.doc_id = p.hit),
             n AS (SELECT doc_id, {SHARED_SQL} AS near FROM w)
        SELECT e.doc_id, coalesce(e.hit, p.hit) AS match_id,
               CASE WHEN e.hit IS NOT NULL THEN 'hash' WHEN p.hit IS NOT NULL THEN 'prefix' END AS match_by,
               CASE WHEN e.hit IS NOT NULL THEN 1.0 ELSE near END::DOUBLE AS similarity
        FROM e LEFT JOIN p ON e.doc_id = p.doc_id LEFT JOIN n ON n.doc_id = e.doc_id""",
)
def join_hash_then_prefix(t):
    labels = t.labels.select("doc_id")
    lost = t.texts.join(labels, "doc_id", "left_semi").select("doc_id", "text")
    known = t.texts.join(labels, "doc_id", "left_anti").select(F.col("doc_id").alias("known_id"), "text")
    return joins.hash_then_prefix(lost, known, "doc_id", "known_id", "text", T.text_hash)


@query(
    "join_time_range_dup",
    """SELECT event_type, event_id, count(*) OVER w - 1 AS candidates FROM events
       WINDOW w AS (PARTITION BY event_type ORDER BY ts
                    RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW)""",
)
def join_time_range_dup(t):
    return keyed.rows_in_trailing_window(
        t.events, ["event_type"], "event_id", "ts", 48 * 3600, 6 * 3600, "candidates"
    )


@query(
    "join_embedding_cosine",
    """WITH sims AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
                     FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
            best AS (SELECT vec_id, arg_max(other, (round(s, 9), -other)) AS best_id, round(max(s), 6) AS similarity
                     FROM sims WHERE s > 0.75 GROUP BY vec_id)
       SELECT e.vec_id, best_id, similarity, best_id IS NOT NULL AS is_duplicate FROM embeddings e LEFT JOIN best USING (vec_id)""",
)
def join_embedding_cosine(t):
    """Best match above 0.75 among all stored vectors."""
    vectors = t.embeddings.select("vec_id", "embedding")
    return similarity.best_match(vectors, "vec_id", "embedding", threshold=0.75)


@query(
    "join_blacklist_anti",
    """SELECT event_id, user_id, event_type FROM events
       WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def join_blacklist_anti(t):
    listed = t.customer.filter(F.col("c_acctbal") < 0).select("c_custkey")
    return joins.block_listed(t.events.select("event_id", "user_id", "event_type"), "user_id", listed)


@query(
    "join_prior_contact_exists",
    """SELECT e.event_id, e.user_id FROM events e
       WHERE EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_id <> e.event_id
                     AND o.event_type = 'purchase' AND o.value > 200)""",
)
def join_prior_contact_exists(t):
    answered = (F.col("event_type") == "purchase") & (F.col("value") > 200)
    return joins.another_row_exists(t.events, "user_id", "event_id", answered).select("event_id", "user_id")


@query(
    "join_asof_cooldown",
    """WITH o AS (SELECT event_id, user_id, ts, event_type,
                         max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id
                           ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS touched
                  FROM events)
       SELECT event_id, user_id, touched AS last_touch,
              coalesce(touched >= ts - INTERVAL 24 HOUR, false) AS cooling_down
       FROM o WHERE event_type <> 'purchase'""",
)
def join_asof_cooldown(t):
    touch = F.when(F.col("event_type") == "purchase", F.col("ts"))
    touched = keyed.previous_value(
        t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], touch, by_day(),
        "last_touch",
    )
    return touched.filter(F.col("event_type") != "purchase").select(
        "event_id",
        "user_id",
        "last_touch",
        F.coalesce(F.col("last_touch") >= F.col("ts") - F.expr("INTERVAL 24 HOUR"), F.lit(False)).alias(
            "cooling_down"
        ),
    )


@query(
    "join_best_case",
    """WITH w AS (SELECT p_partkey, p_type, p_name, string_split(p_name, ' ') AS words FROM part),
            c AS (SELECT min(p_partkey) AS case_id, p_type, split_part(p_name, ' ', 2) AS niche,
                         [split_part(p_name, ' ', 2), 'large'] AS kws
                  FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY p_type, niche),
            s AS (SELECT w.p_partkey, c.case_id, least(round(
                    CASE WHEN contains(c.niche, w.p_name) THEN 1.0 ELSE 0.0 END
                    + len(list_intersect(w.words, c.kws)) / len(c.kws)
                    + 0.3 * len(list_filter(c.kws, lambda k: contains(w.p_name, k))), 6), 1.0) AS score
                  FROM w JOIN c ON w.p_type = c.p_type),
            b AS (SELECT p_partkey, arg_max(case_id, (score, -case_id)) AS best, max(score) AS score,
                         min(case_id) AS fallback FROM s GROUP BY p_partkey)
       SELECT w.p_partkey, CASE WHEN score > 0 THEN best ELSE fallback END AS case_id,
              CAST(CASE WHEN score > 0 THEN score WHEN fallback IS NOT NULL THEN 0.5 END AS DOUBLE) AS match_score
       FROM w LEFT JOIN b ON w.p_partkey = b.p_partkey""",
)
def join_best_case(t):
    niche = F.split_part("p_name", F.lit(" "), F.lit(2))
    cases = (
        t.part.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
        .groupBy("p_type", niche.alias("case_niche"))
        .agg(F.min("p_partkey").alias("case_id"))
        .withColumn("case_order", F.col("case_id"))
        .withColumn("case_words", F.array("case_niche", F.lit("large")))
    )
    leads = t.part.select("p_partkey", "p_type", "p_name", F.split("p_name", " ").alias("words"))
    return joins.best_case(leads, cases, "p_type", "p_name", "words").select("p_partkey", "case_id", "match_score")


SEGMENT_SERVICES = {
    "AUTOMOBILE": "gear", "MACHINERY": "bolt", "BUILDING": "plate", "FURNITURE": "anvil",
}  # HOUSEHOLD has none


@query(
    "join_category_service",
    """WITH a(segment, target) AS (VALUES ('AUTOMOBILE', 'gear'), ('MACHINERY', 'bolt'), ('BUILDING', 'plate'),
                                          ('FURNITURE', 'anvil'))
       SELECT c_custkey, c_mktsegment,
              (SELECT min(p_partkey) FROM part WHERE p_name ILIKE '%' || target || '%') AS service_id
       FROM customer LEFT JOIN a ON c_mktsegment = segment""",
)
def join_category_service(t):
    people = t.customer.select("c_custkey", "c_mktsegment")
    return joins.first_service(people, "c_mktsegment", SEGMENT_SERVICES, t.part, "p_name", "p_partkey")


RULE_WORDS = ["license", "threat", "token", "worthless", "pathetic", "disgusting", "tion of the", "und die", "de la"]


@query(
    "join_rules_theta",
    "SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM documents, (SELECT unnest(["
    + ", ".join(f"'{w}'" for w in RULE_WORDS)
    + "]) AS rule) WHERE contains(lower(text), rule) GROUP BY rule",
)
def join_rules_theta(t):
    """Texts against rule literals: the bounded rule list travels inside the expression, no pair join."""
    rules = F.array(*map(F.lit, RULE_WORDS))
    hits = T.let(F.lower("text"), lambda low: F.filter(rules, lambda r: F.contains(low, r)))
    return (
        t.documents.select("doc_id", F.explode(hits).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    )


@query("join_recent_similar")
def join_recent_similar(t):
    """Latest assistant turn against the 10 assistant turns before it in the same conversation."""
    sent = t.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    newest = keyed.top_n_per_key(sent, ["conv_id"], [F.desc("turn")], 11, ["turn"])
    draft = newest.filter(F.col("rank_in_key") == 1).select("conv_id", "turn", F.col("text").alias("draft"))
    older = newest.filter(F.col("rank_in_key") > 1).select("conv_id", F.col("text").alias("sent"))
    scored = draft.join(older, "conv_id").withColumn("ratio", similarity.sequence_ratio("draft", "sent"))
    return scored.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("compared"),
        F.round(F.max("ratio"), 6).alias("best_ratio"),
        (F.max("ratio") > 0.85).alias("is_repeat"),
    )


@query(
    "join_id_or_username",
    """SELECT o_orderkey, coalesce(n.c_custkey, i.c_custkey) AS person
       FROM (SELECT o_orderkey, o_custkey, 'Customer#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS handle
             FROM orders) o
       LEFT JOIN customer n ON o.handle = n.c_name LEFT JOIN customer i ON o.o_custkey = i.c_custkey""",
)
def join_id_or_username(t):
    mentions = t.orders.select(
        "o_orderkey",
        "o_custkey",
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("handle"),
    )
    return joins.by_name_or_id(
        mentions, t.customer, ("handle", "c_name"), ("o_custkey", "c_custkey"), "c_custkey", "person"
    ).select("o_orderkey", "person")


@query(
    "join_label_batch",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'BUYER' ELSE 'new' END AS status,
              CASE WHEN l.quality = 1 THEN 'reviewed' END AS reason
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.doc_id IS NULL OR (l.quality = 1 AND l.toxic = 0)""",
)
def join_label_batch(t):
    verdict = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "IRRELEVANT").otherwise("BUYER")
    results = t.labels.select("doc_id", verdict.alias("verdict"))
    joined = t.documents.select("doc_id").join(results, "doc_id", "left")
    kept = joined.filter(F.coalesce("verdict", F.lit("new")) != "IRRELEVANT")
    return kept.select(
        "doc_id",
        F.coalesce("verdict", F.lit("new")).alias("status"),
        F.when(F.col("verdict").isNotNull(), "reviewed").alias("reason"),
    )


@query(
    "join_active_distinct",
    """SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey
       WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' AND o_orderstatus = 'O'""",
)
def join_active_distinct(t):
    recent = t.orders.filter(
        (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '2001-01-01'")) & (F.col("o_orderstatus") == "O")
    )
    return t.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        "c_custkey", "c_name"
    )


@query(
    "join_allow_list",
    """SELECT event_id, user_id, event_type FROM events
       WHERE event_type IN (SELECT event_type FROM events GROUP BY event_type HAVING avg(value) > 49)
         AND user_id NOT IN (SELECT user_id FROM events WHERE value > 400)""",
)
def join_allow_list(t):
    allowed = t.events.groupBy("event_type").agg(F.avg("value").alias("m")).filter("m > 49").select("event_type")
    blocked = t.events.filter(F.col("value") > 400).select("user_id")
    rows = t.events.select("event_id", "user_id", "event_type")
    return joins.block_listed(joins.allow_listed(rows, "event_type", allowed), "user_id", blocked).select(
        "event_id", "user_id", "event_type"
    )


@query(
    "join_takeover_detect",
    """WITH automated AS (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
       SELECT o_custkey, min(o_orderdate) AS managed_since, count(*) AS manual_messages
       FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM automated)
       GROUP BY o_custkey""",
)
def join_takeover_detect(t):
    """Outgoing messages that are not among the automated ids (here, urgent orders) mark a person as human-managed."""
    automated = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")
    manual = t.orders.filter(F.col("o_orderstatus") == "F").join(automated, "o_orderkey", "left_anti")
    return manual.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("managed_since"), F.count(F.lit(1)).alias("manual_messages")
    )


@query(
    "join_contains_bidirectional",
    """WITH s AS (SELECT DISTINCT lower(p_brand) AS service FROM part),
            c AS (SELECT lower(p_brand) AS case_name, count(*) AS n FROM part GROUP BY 1)
       SELECT service, case_name, n FROM s, c WHERE contains(service, case_name) OR contains(case_name, service)""",
)
def join_contains_bidirectional(t):
    services = t.part.select(F.lower("p_brand").alias("service")).distinct()
    cases = t.part.groupBy(F.lower("p_brand").alias("case_name")).agg(F.count(F.lit(1)).alias("n"))
    wide = joins.containing(services, "service", cases, "case_name").select("service", "case_name", "n")
    narrow = joins.containing(cases, "case_name", services, "service").select("service", "case_name", "n")
    return wide.union(narrow).distinct()
