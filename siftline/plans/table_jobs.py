"""Table maintenance over the driver tables: each query returns the table's new contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.lexicons.builtin import LATIN
from siftline.operators import cascade, filters, joins, keyed, reports, tables as jobs
from siftline.plans.joins import SHARED_SQL, WORDS_SQL
from siftline.plans.registry import query
from siftline.plans.rules import _BOOSTED, _CONTACT, _REASON
from siftline.plans.text_functions import SQL_SPACE


def flagged(t):
    """Documents with the state columns of a message table, derived from the labels."""
    status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("new")
    response = F.when(F.col("toxic") == 1, "notified").when(F.col("lang") == "fr", "free text").when(
        F.col("lang") == "de", "sent"
    )
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "source", "lang", "n_chars", status.alias("status"), response.alias("response")
    )


_FLAGGED = """SELECT d.doc_id, source, lang, n_chars,
    CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'new' END AS status,
    CASE WHEN toxic = 1 THEN 'notified' WHEN lang = 'fr' THEN 'free text' WHEN lang = 'de' THEN 'sent' END AS response
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(
    "tbl_retention",
    """SELECT event_id, ts, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-10') AS deleted
       FROM events WHERE ts >= TIMESTAMP '2024-01-10'""",
)
def tbl_retention(t):
    cutoff = F.expr("TIMESTAMP_NTZ '2024-01-10'")
    gone = t.events.filter(F.col("ts") < cutoff).agg(reports.n().alias("n")).scalar()
    return jobs.retain_since(t.events, "ts", cutoff).select("event_id", "ts", gone.alias("deleted"))


@query("tbl_delete_criteria", f"SELECT * FROM ({_FLAGGED}) WHERE NOT (status = 'rejected' AND source = 'src1')")
def tbl_delete_criteria(t):
    return jobs.delete_matching(flagged(t), [F.col("status") == "rejected", F.col("source") == "src1"])


@query(
    "tbl_bulk_delete",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def tbl_bulk_delete(t):
    doomed = t.labels.filter(F.col("toxic") == 1)
    return jobs.delete_keys(t.documents.select("doc_id", "source"), doomed, "doc_id")


@query(
    "tbl_soft_delete",
    f"""SELECT doc_id, status, response = 'notified' AND response IS NOT NULL AS is_deleted,
               CASE WHEN response = 'notified' THEN TIMESTAMP '2024-01-30 00:00:00' END AS deleted_at FROM ({_FLAGGED})""",
)
def tbl_soft_delete(t):
    rows = flagged(t).select("doc_id", "status", "response", F.lit(False).alias("is_deleted"))
    marked = jobs.set_where(
        rows,
        F.col("response") == "notified",
        {"is_deleted": F.lit(True), "deleted_at": F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")},
    )
    return marked.drop("response")


_PATCHES = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'archive' END AS source,
    CASE WHEN quality = 0 THEN 'xx' END AS lang FROM labels"""


def patches(t):
    return t.labels.select(
        "doc_id", F.when(F.col("toxic") == 1, "archive").alias("source"), F.when(F.col("quality") == 0, "xx").alias("lang")
    )


@query(
    "tbl_patch_audit",
    f"""WITH p AS ({_PATCHES})
        SELECT 'row' AS kind, d.doc_id AS entity_id, coalesce(p.source, d.source) || '/' || coalesce(p.lang, d.lang) AS payload
        FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id
        UNION ALL
        SELECT 'audit', d.doc_id, '{{"source":"' || d.source || '","lang":"' || d.lang || '"}} -> {{'
               || array_to_string(list_filter(['"source":"' || p.source || '"', '"lang":"' || p.lang || '"'],
                                              lambda x: x IS NOT NULL), ',') || '}}'
        FROM documents d JOIN p ON d.doc_id = p.doc_id""",
)
def tbl_patch_audit(t):
    docs, changes = t.documents.select("doc_id", "source", "lang"), patches(t)
    rows = jobs.patch(docs, changes, "doc_id", ["source", "lang"])
    audit = jobs.audit_rows(docs, changes, "doc_id", ["source", "lang"], "update")
    return rows.select(
        F.lit("row").alias("kind"), F.col("doc_id").alias("entity_id"), F.concat_ws("/", "source", "lang").alias("payload")
    ).union(audit.select(F.lit("audit"), "entity_id", F.concat_ws(" -> ", "old_value", "new_value")))


@query(
    "tbl_archive_reprocess",
    f"""WITH s AS ({_FLAGGED})
        SELECT 'row' AS kind, doc_id, response = 'notified' AND response IS NOT NULL AS is_archived,
               CASE WHEN status = 'rejected' THEN 0 ELSE 3 END AS stage,
               CASE WHEN status = 'rejected' THEN '{{}}' ELSE '{{"done":true}}' END AS log FROM s
        UNION ALL SELECT 'archive', doc_id, true, NULL, NULL FROM s WHERE response = 'notified'
        UNION ALL SELECT 'reprocess', doc_id, NULL, 0, '{{}}' FROM s WHERE status = 'rejected'""",
)
def tbl_archive_reprocess(t):
    rows = flagged(t).withColumns(
        {"is_archived": F.lit(False), "stage": F.lit(3), "log": F.lit('{"done":true}')}
    )
    archive, redo = F.col("response") == "notified", F.col("status") == "rejected"
    changed = jobs.set_where(rows, archive, {"is_archived": F.lit(True)})
    changed = jobs.set_where(changed, redo, {"stage": F.lit(0), "log": F.lit("{}")})
    null = F.lit(None)
    table = changed.select(F.lit("row").alias("kind"), "doc_id", "is_archived", "stage", "log")
    archived = rows.filter(archive).select(
        F.lit("archive"), "doc_id", F.lit(True), null.cast("int"), null.cast("string")
    )
    redone = rows.filter(redo).select(F.lit("reprocess"), "doc_id", null.cast("boolean"), F.lit(0), F.lit("{}"))
    return table.union(archived).union(redone)


@query(
    "tbl_reset_stuck",
    f"""SELECT doc_id, status, CASE WHEN status = 'accepted' AND response IN ('notified', 'free text') THEN NULL
               ELSE response END AS response FROM ({_FLAGGED})""",
)
def tbl_reset_stuck(t):
    """Accepted rows with a free-text or ``notified`` response go back to pending; known codes stay."""
    codes = ["sent", "processed", "rejected"]
    stuck = (F.col("status") == "accepted") & F.col("response").isNotNull() & ~F.col("response").isin(*codes)
    return jobs.set_where(
        flagged(t).select("doc_id", "status", "response"), stuck, {"response": F.lit(None).cast("string")}
    )


_NEGATIVES = ["license", "threat", "idiot"]


@query(
    "tbl_revalidate",
    """WITH h AS (SELECT d.doc_id, l.quality, l.toxic, CASE WHEN contains(lower(text), 'license') THEN 'license'
                         WHEN contains(lower(text), 'threat') THEN 'threat' WHEN contains(lower(text), 'idiot') THEN 'idiot'
                         END AS hit FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
       SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 AND hit IS NOT NULL THEN 'rejected'
                      WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status,
              CASE WHEN quality = 1 AND toxic = 0 AND hit IS NOT NULL THEN 'AUTO_REVALIDATION: ' || hit END AS reason
       FROM h""",
)
def tbl_revalidate(t):
    """Pending accepted rows that contain a current negative are rejected with the first hit."""
    rows = t.documents.join(t.labels, "doc_id")
    negatives = F.array(*map(F.lit, _NEGATIVES))
    hit = T.let(F.lower("text"), lambda low: F.get(F.filter(negatives, lambda n: F.contains(low, n)), 0))
    checked = rows.select(
        "doc_id",
        F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), hit).alias("_hit"),
    )
    updated = jobs.set_where(
        checked,
        F.col("_hit").isNotNull(),
        {"status": F.lit("rejected"), "reason": F.concat(F.lit("AUTO_REVALIDATION: "), "_hit")},
    )
    return updated.drop("_hit")


#: Share of words that a stored text with the same head must have in common, for its contact to be taken over.
ALIKE = 0.5


@query(
    "tbl_recover_contacts",
    f"""WITH l AS (SELECT doc_id, text, {_CONTACT} AS in_text,
                          md5(regexp_replace(lower(text), '[{SQL_SPACE}]+', '', 'g')) AS hash
                   FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
             r AS (SELECT doc_id, text, md5(regexp_replace(lower(text), '[{SQL_SPACE}]+', '', 'g')) AS hash
                   FROM documents ANTI JOIN labels USING (doc_id)),
             h AS (SELECT hash, min(doc_id) AS hit FROM r GROUP BY hash),
             e AS (SELECT l.*, h.hit FROM l LEFT JOIN h ON l.hash = h.hash),
             p AS (SELECT e.doc_id, min(r.doc_id) AS hit FROM e JOIN r ON starts_with(r.text, substr(e.text, 1, 100))
                   WHERE e.hit IS NULL GROUP BY 1),
             w AS (SELECT p.doc_id, {WORDS_SQL.format("e.text")} AS a, {WORDS_SQL.format("r.text")} AS b
                   FROM p JOIN e ON e.doc_id = p.doc_id JOIN r ON r.doc_id = p.hit),
             n AS (SELECT doc_id, {SHARED_SQL} AS near FROM w),
             m AS (SELECT e.doc_id, in_text, coalesce(e.hit, CASE WHEN near >= {ALIKE} THEN p.hit END) AS match_id
                   FROM e LEFT JOIN p ON e.doc_id = p.doc_id LEFT JOIN n ON n.doc_id = e.doc_id)
        SELECT doc_id, in_text, match_id, CASE WHEN in_text THEN 'text' WHEN match_id IS NOT NULL THEN 'stored' ELSE 'none' END AS found_in
        FROM m""",
)
def tbl_recover_contacts(t):
    """Accepted rows without a contact: contact read from the text, else from the same text stored elsewhere."""
    from siftline.functions import entities

    spans = entities.contact_spans(F.col("text"))
    accepted = t.documents.join(t.labels.filter(F.col("quality") == 1), "doc_id", "left_semi").select("doc_id", "text")
    stored = t.documents.join(t.labels, "doc_id", "left_anti").select(F.col("doc_id").alias("known_id"), "text")
    matched = joins.hash_then_prefix(accepted, stored, "doc_id", "known_id", "text", T.text_hash)
    matched = matched.withColumn("match_id", F.when(F.col("similarity") >= ALIKE, F.col("match_id")))
    return (
        accepted.select("doc_id", spans["has_contact"].alias("in_text"))
        .join(matched, "doc_id")
        .select(
            "doc_id",
            "in_text",
            F.when(F.col("in_text"), "text").when(F.col("match_id").isNotNull(), "stored").otherwise("none").alias("found_in"),
            "match_id",
        )
    )


@query(
    "tbl_reprocess_rejected",
    f"""WITH {_BOOSTED} SELECT doc_id, CASE WHEN is_lead AND has_contact THEN 'accepted' ELSE 'rejected' END AS status,
               {_REASON} AS reason, tier FROM t SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0) USING (doc_id)
        WHERE contains(lower(text), 'threat') OR contains(lower(text), 'tion') OR contains(lower(text), 'und')
           OR contains(lower(text), 'les')""",
)
def tbl_reprocess_rejected(t):
    """Rejected rows that mention a wanted word go through the cascade again; leads with a contact are promoted."""
    from siftline.functions import entities

    rejected = t.texts.join(t.labels.filter(F.col("quality") == 0), "doc_id", "left_semi")
    candidates = rejected.filter(filters.contains_any(F.col("text"), ["threat", "tion", "und", "les"]))
    again = cascade.triage(candidates, LATIN)
    found = F.col("is_lead") & entities.contact_spans(F.col("text"))["has_contact"]
    return again.select("doc_id", F.when(found, "accepted").otherwise("rejected").alias("status"), "reason", "tier")


@query(
    "tbl_version_append",
    """WITH v AS (SELECT conv_id, turn AS version, md5(text) AS content FROM conversations),
            cur AS (SELECT conv_id, max(version) AS version, arg_max(content, version) AS content FROM v GROUP BY 1),
            ch AS (SELECT conv_id, arg_min(content, version) AS content FROM v GROUP BY 1)
       SELECT * FROM v UNION ALL
       SELECT ch.conv_id, cur.version + 1, ch.content FROM ch JOIN cur USING (conv_id) WHERE ch.content <> cur.content""",
)
def tbl_version_append(t):
    """The first text of each conversation is offered as a new version."""
    versions = t.conversations.select("conv_id", F.col("turn").alias("version"), F.md5("text").alias("content"))
    offered = versions.groupBy("conv_id").agg(F.min_by("content", "version").alias("content"))
    return jobs.append_version(versions, offered, "conv_id", "content")


@query(
    "tbl_version_rollback",
    """WITH v AS (SELECT conv_id, turn AS version, md5(text) AS content FROM conversations)
       SELECT * FROM v UNION ALL
       SELECT o.conv_id, m.top + 1, o.content FROM v o JOIN (SELECT conv_id, max(version) AS top FROM v GROUP BY 1) m
         USING (conv_id) WHERE o.version = 1""",
)
def tbl_version_rollback(t):
    versions = t.conversations.select("conv_id", F.col("turn").alias("version"), F.md5("text").alias("content"))
    target = versions.filter(F.col("version") == 1).select("conv_id", "version")
    return jobs.rollback(versions, target, "conv_id", "content")


@query(
    "tbl_config_set",
    """SELECT n_nationkey, n_name, coalesce('changed ' || r_name, 'default') AS value
       FROM nation LEFT JOIN region ON n_nationkey = r_regionkey""",
)
def tbl_config_set(t):
    """Existing keys are updated, unknown keys ignored."""
    config = t.nation.select("n_nationkey", "n_name", F.lit("default").alias("value"))
    changes = t.region.select(
        F.col("r_regionkey").alias("n_nationkey"), F.concat(F.lit("changed "), "r_name").alias("value")
    )
    return jobs.patch(config, changes, "n_nationkey", ["value"])


@query(
    "tbl_mark_spam_by_contact",
    """SELECT o_orderkey, CASE WHEN c_name LIKE '%0007%' THEN 'rejected' ELSE o_orderstatus END AS status,
              CASE WHEN c_name LIKE '%0007%' THEN 'SPAM_CONTACT' END AS reason
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def tbl_mark_spam_by_contact(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "c_name"
    )
    spam = F.col("c_name").contains("0007")
    return jobs.set_where(rows, spam, {"status": F.lit("rejected"), "reason": F.lit("SPAM_CONTACT")}).drop("c_name")


@query("tbl_deactivate", "SELECT p_partkey, p_name FROM part WHERE NOT (p_size < 5)")
def tbl_deactivate(t):
    rows = t.part.select("p_partkey", "p_name", "p_size", F.lit(True).alias("is_active"))
    off = jobs.set_where(rows, F.col("p_size") < 5, {"is_active": F.lit(False)})
    return off.filter("is_active").select("p_partkey", "p_name")


@query(
    "tbl_weekly_quality_batches",
    """WITH r AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch
                  FROM documents SEMI JOIN labels USING (doc_id))
       SELECT batch, count(*) AS n, md5(string_agg('[' || doc_id || '] ' || replace(text, chr(10), ' '),
              chr(10) ORDER BY doc_id)) AS lines_key FROM r GROUP BY batch""",
)
def tbl_weekly_quality_batches(t):
    """Batches of 100 texts, each on one line, for an external reviewer."""
    line = F.concat(F.lit("["), "doc_id", F.lit("] "), F.translate("text", "\n", " "))
    rows = t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", line.alias("line"))
    numbered = keyed.global_row_number(rows, "doc_id", F.floor(F.col("doc_id") / 100_000), "position")
    lines = F.array_sort(F.collect_list(F.struct("position", "line")))
    return numbered.groupBy(F.floor((F.col("position") - 1) / 100).alias("batch")).agg(
        reports.n().alias("n"),
        F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("lines_key"),
    )


@query(
    "tbl_dialog_start_stop",
    """SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'stopped' ELSE 'active' END AS status,
              max(turn) AS last_message_at, arg_max(role, turn) AS last_role,
              CASE WHEN bool_or(role = 'system') THEN max(turn) END AS ended_at
       FROM conversations GROUP BY conv_id""",
)
def tbl_dialog_start_stop(t):
    dialogs = t.conversations.groupBy("conv_id").agg(
        F.bool_or(F.col("role") == "system").alias("_stop"),
        F.max("turn").alias("last_message_at"),
        F.max_by("role", "turn").alias("last_role"),
    )
    stopped = jobs.set_where(
        dialogs.withColumn("status", F.lit("active")),
        F.col("_stop"),
        {"status": F.lit("stopped"), "ended_at": F.col("last_message_at")},
    )
    return stopped.drop("_stop")


@query(
    "tbl_apply_decisions",
    f"""WITH s AS ({_FLAGGED}), d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'block' WHEN quality = 0 THEN 'reject: low quality'
               ELSE 'duplicate' END AS action FROM labels)
        SELECT s.doc_id, CASE WHEN action IS NULL THEN status WHEN action = 'duplicate' THEN status ELSE 'rejected' END AS status,
               CASE action WHEN 'block' THEN 'MANUAL_BLOCK' WHEN 'duplicate' THEN 'DUPLICATE'
                    WHEN 'reject: low quality' THEN 'USER_REJECT: low quality' END AS reason,
               CASE WHEN action IS NOT NULL THEN 'processed' ELSE response END AS response
        FROM s LEFT JOIN d ON s.doc_id = d.doc_id""",
)
def tbl_apply_decisions(t):
    action = F.when(F.col("toxic") == 1, "block").when(F.col("quality") == 0, "reject: low quality").otherwise("duplicate")
    decisions = t.labels.select("doc_id", action.alias("action"))
    rows = flagged(t).select("doc_id", "status", "response").join(decisions, "doc_id", "left")
    code = (
        F.when(F.col("action") == "block", "MANUAL_BLOCK")
        .when(F.col("action") == "duplicate", "DUPLICATE")
        .when(F.col("action").startswith("reject: "), F.concat(F.lit("USER_REJECT: "), F.expr("substring(action, 9)")))
        .when(F.col("action") == "reject", "MANUAL_REJECT")
    )
    given = F.col("action").isNotNull()
    coded = rows.withColumn("reason", code)
    coded = jobs.set_where(coded, given & (F.col("action") != "duplicate"), {"status": F.lit("rejected")})
    return jobs.set_where(coded, given, {"response": F.lit("processed")}).drop("action")


@query(
    "tbl_dimension_upsert",
    """SELECT coalesce(n_nationkey, r_regionkey + 23) AS id, coalesce('new ' || r_name, n_name) AS name, n_regionkey AS region
       FROM nation FULL JOIN region ON n_nationkey = r_regionkey + 23""",
)
def tbl_dimension_upsert(t):
    """Known keys are patched, new ones inserted."""
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    given = t.region.select((F.col("r_regionkey") + 23).alias("id"), F.concat(F.lit("new "), "r_name").alias("name"))
    return jobs.patch_or_insert(rows, given, "id", ["name"])
