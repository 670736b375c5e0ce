"""Rule engine over the driver tables.

The documents are Latin text, so the cascade runs on them with the Latin lexicon; the SQL side is built from
the same lexicon.  Russian rules run on messages that are derived from the orders.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftline.functions import automaton, text as T
from siftline.lexicons import examples
from siftline.lexicons.builtin import LATIN, RUSSIAN
from siftline.operators import cascade, scorer
from siftline.plans.registry import query
from siftline.session import cut_lineage, spread
from siftline.plans.text_functions import SQL_SPACE, SQL_WORD


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(prefix: str, entries, column: str = "low") -> str:
    return " ".join(f"WHEN contains(low, {_s(e)}) OR contains(fold, {_s(e)}) THEN {_s(prefix + e)}" for e in entries)


def _list_cases(prefix: str, entries) -> str:
    return " ".join(f"WHEN contains(low, {_s(e)}) THEN {_s(prefix + e)}" for e in entries)


_FEATURES = rf"""
  n AS (SELECT doc_id, text, source, lang,
               translate(nfc_normalize(text), '{"".join(T.LOOKALIKES)}', '{"".join(T.LOOKALIKES.values())}') AS norm
        FROM documents),
  l AS (SELECT *, lower(norm) AS low, translate(lower(norm), '{T.FOLD_FROM}', '{T.FOLD_TO}') AS fold FROM n),
  f AS (SELECT *, len(regexp_extract_all(regexp_replace(low, '[^{SQL_WORD}{SQL_SPACE}]', '', 'g'), '[^{SQL_SPACE}]+'))
                    AS words,
               len(regexp_extract_all(norm, '[{T.EMOJI_BLOCKS}]+')) AS emoji,
               len(regexp_extract_all(low, '#[{SQL_WORD}]+')) AS tags,
               regexp_extract_all(norm, '@[{SQL_WORD}]+') AS names,
               list_transform(regexp_extract_all(low, '(\d+)[{SQL_SPACE}]*(?:{T.CURRENCY})', 1),
                              lambda n: CAST(n AS BIGINT)) AS amounts
        FROM l),
  g AS (SELECT *, coalesce(list_avg(amounts), 0) AS budget FROM f)"""

_BLOCK = f"""CASE {_list_cases('BLACKLIST_DOMAIN: ', LATIN.domains)} {_list_cases('BLACKLIST_BOT: ', LATIN.bots)}
  {' '.join(f"WHEN regexp_matches(low, {_s(p)}) OR regexp_matches(fold, {_s(p)}) THEN {_s('SCAM_PATTERN: ' + p)}"
            for p in LATIN.scam_patterns)}
  {_cases('SCAM_KEYWORD: ', LATIN.scam_words)} {_cases('IRRELEVANT_NICHE: ', LATIN.irrelevant)}
  {_cases('CUSTOM_PHRASE: ', LATIN.custom)}
  WHEN words > 0 AND emoji / words > 0.3 THEN printf('EMOJI_SPAM: density=%.2f', emoji / words)
  WHEN words < 5 THEN 'TOO_SHORT: ' || words || ' words' WHEN tags >= 4 THEN 'HASHTAG_AGGREGATOR: ' || tags || ' hashtags'
  WHEN len(list_filter(names, lambda m: regexp_matches(m, '{LATIN.bot_names[0]}'))) > 0
    THEN 'BOT_ACCOUNT: ' || list_filter(names, lambda m: regexp_matches(m, '{LATIN.bot_names[0]}'))[1] END"""


def _score_sql() -> str:
    parts = []
    for group in LATIN.groups:
        for e in group.entries:
            count = f"len(regexp_extract_all(low, {_s(e)}))" if group.regex else f"contains(low, {_s(e)})::INT"
            parts.append(f"{count} * ({group.weight})")
    parts.append("CASE WHEN budget > 5000 THEN 1 WHEN budget > 0 AND budget < 1000 THEN -2 ELSE 0 END")
    return " + ".join(parts)


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(_s, values))})"


def _direction_sql(lex=LATIN, table="documents", key="doc_id") -> str:
    cues = "|".join(lex.request_cues)
    rows = ", ".join(
        f"({_s(topic)}, {order}, {_s(w)})"
        for order, (topic, ws) in enumerate(lex.directions.items())
        for w in ws
    )
    negated = "|".join(f"(?:{n})" for n in lex.negations).replace("{kw}", "' || regexp_escape(kw) || '")
    return f"""
  kw(topic, ord, kw) AS (VALUES {rows}),
  hit AS (SELECT {key}, topic, ord, CASE WHEN regexp_matches(lowraw, '{negated}') THEN -10.0
            WHEN regexp_matches(substr(lowraw, greatest(pos - 80, 1), pos + length(kw) + 80 - greatest(pos - 80, 1)),
                                '{cues}') THEN 2.5 ELSE 1.0 END AS weight
          FROM (SELECT {key}, lower(text) AS lowraw, topic, ord, kw, instr(lower(text), kw) AS pos
                FROM {table}, kw WHERE contains(lower(text), kw))),
  total AS (SELECT {key}, topic, ord, sum(weight) AS total FROM hit GROUP BY ALL),
  best AS (SELECT {key}, arg_max(topic, (total, -ord)) AS topic FROM total WHERE total > 0 GROUP BY {key}),
  dir AS (SELECT d.{key}, coalesce(topic, 'Unknown') AS direction FROM {table} d LEFT JOIN best USING ({key}))"""


_TRUST = f"CASE WHEN {_in('source', LATIN.sources_high)} THEN 1 WHEN {_in('source', LATIN.sources_low)} THEN -1 ELSE 0 END"
_TOPIC = (
    f"CASE WHEN {_in('direction', LATIN.topics_core)} THEN 2 WHEN {_in('direction', LATIN.topics_secondary)} THEN 1 "
    f"WHEN {_in('direction', LATIN.topics_irrelevant)} THEN -2 ELSE 0 END"
)
_BANNED = _in("source", LATIN.sources_blocked)

_DECISION = f"""{_FEATURES}, {_direction_sql()},
  s AS (SELECT g.*, direction, {_BLOCK} AS block, {_score_sql()} AS score, {_TRUST} AS trust, {_TOPIC} AS topic_weight
        FROM g JOIN dir USING (doc_id)),
  d AS (SELECT *, CASE WHEN block IS NOT NULL THEN NULL WHEN {_BANNED} THEN -999
                       ELSE score + trust + topic_weight END AS final FROM s),
  r AS (SELECT *, CASE WHEN block IS NOT NULL THEN 'LEVEL_1_HARD_BLOCK' WHEN {_BANNED} THEN 'LEVEL_3_CONTEXT_BLOCK'
                  WHEN final >= 3 OR final <= -2 THEN 'LEVEL_2_HEURISTIC' ELSE 'REVIEW' END AS stage,
               block IS NULL AND NOT ({_BANNED}) AND final >= 3 AS is_lead FROM d)"""

_REASON = f"""CASE WHEN block IS NOT NULL THEN block WHEN {_BANNED} THEN 'BLACKLIST_SOURCE: ' || source
               WHEN final >= 3 THEN 'HEURISTIC_ACCEPT: score=' || final
               WHEN final <= -2 THEN 'HEURISTIC_REJECT: score=' || final ELSE 'UNCERTAIN: score=' || final END"""
_LOWTEXT = "lower(text)"
_URGENT = " OR ".join(f"contains({_LOWTEXT}, {_s(u)})" for u in LATIN.urgent)
_QUALITY = " + ".join(f"contains({_LOWTEXT}, {_s(u)})::INT" for u in LATIN.quality)
_PRIORITY = f"""greatest(0, least(100, 50 + CASE WHEN budget > 50000 THEN 20 WHEN budget > 20000 THEN 15
  WHEN budget > 10000 THEN 10 WHEN budget > 5000 THEN 5 ELSE 0 END + CASE WHEN {_URGENT} THEN 10 ELSE 0 END
  + 5 * ({_QUALITY}) + 10 * ({_TRUST}) + CASE WHEN {_in('direction', LATIN.topics_core)} THEN 15 ELSE 0 END
  + CASE WHEN final >= 5 THEN 10 ELSE 0 END))"""
_CONTACT = r"""(regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')
  OR regexp_matches(text, '(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}')
  OR regexp_matches(text, '@([a-zA-Z0-9_]{5,})'))"""
_BOOSTED = f"""{_DECISION},
  p AS (SELECT *, {_PRIORITY} AS base, {_CONTACT} AS has_contact FROM r),
  b AS (SELECT *, greatest(0, least(100, base + CASE WHEN has_contact THEN 5 ELSE 0 END)) AS raised FROM p),
  t AS (SELECT *, CASE WHEN is_lead THEN raised ELSE 0 END AS priority,
               CASE WHEN NOT is_lead THEN 'COLD' WHEN raised >= 70 THEN 'HOT' WHEN raised >= 50 THEN 'WARM'
                    ELSE 'COLD' END AS tier FROM b)"""


def featured(t):
    return cascade.with_direction(T.features(t.texts, "text"), "text", LATIN)


def triaged(t):
    return cascade.triage(t.texts, LATIN)


@query("rule_hard_block", f"WITH {_FEATURES} SELECT doc_id, {_BLOCK} AS reason FROM g")
def rule_hard_block(t):
    return T.features(t.texts, "text").select("doc_id", cascade.block_reason(LATIN).alias("reason"))


@query("rule_weighted_score", f"WITH {_FEATURES} SELECT doc_id, CAST({_score_sql()} AS INTEGER) AS score FROM g")
def rule_weighted_score(t):
    scored = T.features(t.texts, "text").select("doc_id", cascade.weighted_score(LATIN).alias("s"))
    return scored.select("doc_id", "s.score")


@query(
    "rule_context_adjust",
    f"""WITH {_FEATURES}, {_direction_sql()}
        SELECT doc_id, CAST({_score_sql()} + {_TRUST} + {_TOPIC} AS INTEGER) AS final_score, {_BANNED} AS blocked
        FROM g JOIN dir USING (doc_id)""",
)
def rule_context_adjust(t):
    df = featured(t).withColumn("s", cascade.weighted_score(LATIN))
    adjusted = cascade.context_adjust(LATIN, F.col("s.score"), F.col("source"), F.col("direction"))
    return df.select("doc_id", adjusted["final_score"].alias("final_score"),
                     F.col("source").isin(*LATIN.sources_blocked).alias("blocked"))


@query("rule_direction", f"WITH {_direction_sql()} SELECT doc_id, direction FROM dir")
def rule_direction(t):
    return t.texts.select("doc_id", cascade.direction_score(F.col("text"), LATIN).alias("direction"))


KEYWORDS = [word for words in RUSSIAN.directions.values() for word in words]


def keyword_messages(t):
    """Russian messages that hold every keyword of the topic vocabulary, asked for, offered, negated and beside another one."""
    words = F.array(*map(F.lit, KEYWORDS))
    word = lambda shift: F.get(words, F.pmod(F.col("o_orderkey") + shift, F.lit(len(KEYWORDS))).cast("int"))
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.concat(F.lit("Нужен специалист: "), word(0), F.lit(". Бюджет "), F.floor(F.col("o_totalprice") / 1000), F.lit(" тыс")))
        .when(status == "O", F.concat(F.lit("Предлагаю "), word(0), F.lit(" и "), word(97), F.lit(" недорого")))
        .otherwise(F.concat(F.lit("Нам не нужен "), word(0), F.lit(", без "), word(31), F.lit(", но ищем "), word(211)))
    )
    return spread(t.orders).select("o_orderkey", text.alias("text"))


_KEYWORD_MESSAGES = f"""
  words AS (SELECT [{", ".join(map(_s, KEYWORDS))}] AS w),
  messages AS (SELECT o_orderkey, CASE o_orderstatus
      WHEN 'F' THEN 'Нужен специалист: ' || w[o_orderkey % {len(KEYWORDS)} + 1] || '. Бюджет ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || ' тыс'
      WHEN 'O' THEN 'Предлагаю ' || w[o_orderkey % {len(KEYWORDS)} + 1] || ' и ' || w[(o_orderkey + 97) % {len(KEYWORDS)} + 1] || ' недорого'
      ELSE 'Нам не нужен ' || w[o_orderkey % {len(KEYWORDS)} + 1] || ', без ' || w[(o_orderkey + 31) % {len(KEYWORDS)} + 1]
           || ', но ищем ' || w[(o_orderkey + 211) % {len(KEYWORDS)} + 1] END AS text FROM orders, words)"""


@query("rule_direction_ru", f"WITH {_KEYWORD_MESSAGES}, {_direction_sql(RUSSIAN, 'messages', 'o_orderkey')} SELECT o_orderkey, direction FROM dir")
def rule_direction_ru(t):
    """Topics by the whole Russian vocabulary, found in one pass over each text."""
    return keyword_messages(t).select("o_orderkey", cascade.direction_of(F.col("text"), RUSSIAN).alias("direction"))


@query(
    "join_rules_table",
    """WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS rule FROM benchmark),
            m AS (SELECT rule, doc_id, instr(lower(text), rule) AS pos FROM documents, r WHERE contains(lower(text), rule))
       SELECT rule, count(*) AS n, min(doc_id) AS first_doc, min(pos) AS nearest FROM m GROUP BY rule""",
)
def join_rules_table(t):
    """Texts against a rule table of any size: here the longer words of the benchmark."""
    rules = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("rule")).distinct()
    rows = t.texts.select("doc_id", F.lower("text").alias("text"))
    found = automaton.multi_match(rows, "doc_id", "text", rules.withColumn("pattern", F.col("rule")), "rule", "pattern")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.min("at").cast("long").alias("nearest"))


@query(
    "rule_negation",
    """SELECT o_orderkey, o_orderstatus <> 'P' AS negated FROM orders""",
)
def rule_negation(t):
    """Negated and owned services are not requests for them."""
    status = F.col("o_orderstatus")
    message = (
        F.when(status == "F", "Нам не нужен директ, спасибо").when(status == "O", "у нас есть авито, ищем другое")
        .otherwise("Ищем авито специалиста")
    )
    return t.orders.select(
        "o_orderkey", (cascade.direction_score(message, RUSSIAN) == "Unknown").alias("negated")
    )


@query(
    "rule_hard_block_normalized",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'UNICODE_IRRELEVANT: бухгалтерия'
              WHEN 'O' THEN 'UNICODE_SPAM: 2 spam keywords after normalization' END AS reason FROM orders""",
)
def rule_hard_block_normalized(t):
    """Rows whose lower-cased text changes once more, by an upper-case Ё."""
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", "Нужна бухгалтЁрия срочно и недорого сегодня")
        .when(status == "O", "набЁр: зарплата от рекордной, ищЁм в штат; дЁшево, курс по всЁм, в нашу команду")
        .otherwise("Нужен сайт для большого магазина запчастей")
    )
    rows = T.features(spread(t.orders).select("o_orderkey", text.alias("text")), "text")
    rows = T.computed_once(rows, ["o_orderkey", "lowered"], [F.col(name) for name in cascade.BLOCK_FEATURES if name != "lowered"])
    lexicon = RUSSIAN_SECOND_PASS
    return rows.select("o_orderkey", cascade.block_reason(lexicon).alias("reason"))


def _second_pass():
    from dataclasses import replace

    return replace(RUSSIAN, repeated_spam=["ищем в штат", "по всем"], groups=[])


RUSSIAN_SECOND_PASS = _second_pass()


@query(
    "rule_cascade",
    f"""WITH {_DECISION} SELECT doc_id, stage, is_lead,
          (CASE stage WHEN 'LEVEL_2_HEURISTIC' THEN 0.85 WHEN 'REVIEW' THEN 0.5 ELSE 0.99 END)::DOUBLE AS confidence,
          CAST(final AS INTEGER) AS final_score, direction, stage = 'REVIEW' AS needs_review,
          {_REASON} AS reason FROM r""",
)
def rule_cascade(t):
    return cascade.cascade(featured(t), LATIN).select(
        "doc_id", "stage", "is_lead", "confidence", "final_score", "direction", "needs_review", "reason"
    )


@query(
    "rule_priority",
    f"""WITH {_DECISION} SELECT doc_id, CAST({_PRIORITY} AS INTEGER) AS priority,
          CASE WHEN {_PRIORITY} >= 70 THEN 'HOT' WHEN {_PRIORITY} >= 50 THEN 'WARM' ELSE 'COLD' END AS tier
        FROM r""",
)
def rule_priority(t):
    df = cascade.cascade(featured(t), LATIN)
    value = cascade.priority(
        F.col("text"), F.col("source"), F.col("direction"), F.col("avg_budget"), F.col("final_score"), LATIN
    )
    return df.select("doc_id", value.alias("p")).select("doc_id", "p.priority", "p.tier")


@query("rule_priority_boost", f"WITH {_BOOSTED} SELECT doc_id, CAST(priority AS INTEGER) AS priority, tier FROM t WHERE is_lead")
def rule_priority_boost(t):
    return triaged(t).filter("is_lead").select("doc_id", "priority", "tier")


@query("rule_default_tier", f"WITH {_BOOSTED} SELECT doc_id, is_lead, tier, CAST(priority AS INTEGER) AS priority, direction FROM t")
def rule_default_tier(t):
    return triaged(t).select("doc_id", "is_lead", "tier", "priority", "direction")


@query(
    "rule_decision_trail",
    f"""WITH {_DECISION} SELECT doc_id, CASE WHEN block IS NOT NULL
              THEN ['hard_blocked: ' || block, 'stage: ' || stage]
              ELSE ['hard_blocks_pass', 'heuristic_score: ' || final, 'model_skipped', 'stage: ' || stage] END AS trail
        FROM r""",
)
def rule_decision_trail(t):
    return triaged(t).select("doc_id", "trail")


@query(
    "triage_overview",
    f"""WITH {_BOOSTED}, x AS (SELECT min(doc_id) AS doc_id FROM documents
              GROUP BY md5(regexp_replace(lower(text), '[{SQL_SPACE}]+', '', 'g')))
        SELECT source, stage, tier, count(*) AS n,
               round(count(*) * 100.0 / (SELECT count(*) FROM x), 2)::DOUBLE AS share_percent
        FROM t SEMI JOIN x USING (doc_id) GROUP BY source, stage, tier""",
)
def triage_overview(t):
    """Flagship: full cascade, exact deduplication, tiers, and counts per source.

    One pass over the texts decides every document; only its hash and decision are shuffled, and copies of a text
    collapse before that.
    """
    decided = cascade.triage(t.texts, LATIN, outputs=("tier",)).select(
        T.text_hash(F.col("text")).alias("hash"), "doc_id", F.struct("source", "stage", "tier").alias("decision")
    )
    fresh = decided.groupBy("hash").agg(F.min_by("decision", "doc_id").alias("decision")).select("decision.*")
    counts = fresh.groupBy("source", "stage", "tier").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)  # the total is taken from the counts, not from a second pass over the texts
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share_percent", F.round(F.col("n") * 100.0 / total, 2)).orderBy(F.desc("n"), "source")


@query(
    "rule_report_priority",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR (o_totalprice > 300000 AND o_orderstatus = 'F') THEN 'HIGH'
              WHEN o_totalprice > 200000 THEN 'MEDIUM' ELSE 'LOW' END AS report_priority FROM orders""",
)
def rule_report_priority(t):
    score = F.when(F.col("o_totalprice") > 300000, 6).when(F.col("o_totalprice") > 200000, 4).otherwise(1)
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "form").otherwise("text_username")
    level = F.when(F.col("o_orderstatus") == "F", "1A").otherwise("4")
    return t.orders.select("o_orderkey", cascade.report_priority(score, kind, level).alias("report_priority"))


@query(
    "rule_stage_toggles",
    """SELECT event_id, CASE WHEN value >= 70 THEN 'HOT' WHEN value >= 40 THEN 'WARM' ELSE 'COLD' END AS tier FROM events""",
)
def rule_stage_toggles(t):
    """Thresholds come from key/value rows (here derived from the regions), defaults where a key is missing."""
    settings = t.region.select(
        F.when(F.col("r_regionkey") == 0, "hot_threshold").otherwise(F.col("r_name")).alias("key"),
        F.when(F.col("r_regionkey") == 0, "70").otherwise("0").alias("value"),
    )
    config = cascade.configured(settings, "key", "value", {"hot_threshold": "80", "warm_threshold": "40"})
    hot = config.select(F.col("hot_threshold").cast("double")).scalar()
    warm = config.select(F.col("warm_threshold").cast("double")).scalar()
    tier = F.when(F.col("value") >= hot, "HOT").when(F.col("value") >= warm, "WARM").otherwise("COLD")
    return t.events.select("event_id", tier.alias("tier"))


def order_messages(t):
    """Russian messages derived from the orders."""
    status, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    amount = F.floor(F.col("o_totalprice") / 1000)
    text = (
        F.when((status == "F") & (rank == "1"), F.concat(F.lit("Нужен seo специалист, удаленно, от "), amount, F.lit(" тыс")))
        .when((status == "F") & (rank == "2"), F.concat(F.lit("Ищу подрядчика: авито, заказ #"), "o_orderkey"))
        .when((status == "F") & (rank == "3"), "Подскажите, кто делает лендинг на tilda? Стажер не нужен")
        .when(status == "F", "Кто может помочь? ищем в команду крутого сеошника")
        .when((status == "O") & (rank == "1"), "Предлагаю услуги: настрою под ключ сайт")
        .when((status == "O") & (rank == "2"), "Приглашаем на вебинар, розыгрыш подарков")
        .when((status == "O") & (rank == "3"), "Нужен специалист по директ, г. Ташкент")
        .when(status == "O", "Требуется smm менеджер и facebook ads")
        .otherwise("Всем хорошего дня")
    )
    return spread(t.orders).select("o_orderkey", text.alias("text"))


def _by_message(f1, f2, f3, f4, o1, o2, o3, o4, p) -> str:
    rank = "substr(o_orderpriority, 1, 1)"
    return f"""CASE WHEN o_orderstatus = 'F' THEN CASE {rank} WHEN '1' THEN {f1} WHEN '2' THEN {f2} WHEN '3' THEN {f3}
                 ELSE {f4} END WHEN o_orderstatus = 'O' THEN CASE {rank} WHEN '1' THEN {o1} WHEN '2' THEN {o2}
                 WHEN '3' THEN {o3} ELSE {o4} END ELSE {p} END"""


def _low():
    return F.lower("text")


@query(
    "scorer_message",
    "SELECT o_orderkey, "
    + _by_message("7", "6", "2", "5", "0", "0", "0", "0", "0")
    + " AS relevance_score, "
    + _by_message("'SEO'", "'авито'", "'разработка сайтов'", "'SEO'", "NULL", "NULL", "NULL", "NULL", "NULL")
    + " AS specialisation, "
    + _by_message("NULL", "NULL", "NULL", "NULL", "'Предложение услуг (Sellers)'", "'Рекламный/промо контент'",
                  "'Исключенная локация: ташкент'", "'Исключено: Блокируемая роль (smm)'",
                  "'Нет demand-сигнала и не формат заказа'")
    + " AS rejection_reason FROM orders",
)
def scorer_message(t):
    return scorer.score_message(order_messages(t), "text").select(
        "o_orderkey", "relevance_score", "specialisation", "rejection_reason"
    )


@query(
    "scorer_spam",
    "SELECT o_orderkey, " + _by_message("false", "false", "false", "false", "false", "true", "false", "false", "false")
    + " AS is_spam FROM orders",
)
def scorer_spam(t):
    return order_messages(t).select("o_orderkey", scorer.is_spam(_low(), scorer.ScorerLexicon()).alias("is_spam"))


@query(
    "scorer_offer_override",
    "SELECT o_orderkey, " + _by_message("false", "false", "false", "false", "true", "false", "false", "false", "false")
    + " AS is_offer FROM orders",
)
def scorer_offer_override(t):
    return order_messages(t).select("o_orderkey", scorer.is_offer(_low(), scorer.ScorerLexicon()).alias("is_offer"))


@query(
    "scorer_specialisation",
    "SELECT o_orderkey, "
    + _by_message("'SEO'", "'авито'", "'разработка сайтов'", "'SEO'", "NULL", "NULL", "'контекстная реклама'", "NULL", "NULL")
    + " AS specialisation, " + _by_message("3", "3", "2", "3", "0", "0", "3", "0", "0") + " AS spec_score FROM orders",
)
def scorer_specialisation(t):
    best = scorer.specialisation(_low(), scorer.ScorerLexicon())
    return order_messages(t).select("o_orderkey", best.alias("b")).select(
        "o_orderkey", F.col("b.name").alias("specialisation"), F.col("b.priority").alias("spec_score")
    )


@query(
    "scorer_demand",
    "SELECT o_orderkey, " + _by_message("2", "2", "2", "2", "0", "2", "2", "2", "0") + " AS demand, "
    + _by_message("0", "3", "3", "0", "0", "0", "0", "0", "0") + " AS context, "
    + _by_message("0", "2", "0", "0", "0", "0", "0", "0", "0") + " AS order_format FROM orders",
)
def scorer_demand(t):
    lex = scorer.ScorerLexicon()
    return order_messages(t).select(
        "o_orderkey",
        scorer.demand(_low(), lex).alias("demand"),
        scorer.context(_low(), lex).alias("context"),
        scorer.order_format(_low(), lex).alias("order_format"),
    )


@query(
    "scorer_exclusions",
    "SELECT o_orderkey, " + _by_message(*["false"] * 7, "true", "false") + " AS excluded_specialisation, "
    + _by_message("0", "0", "-3", "0", "0", "0", "0", "0", "0") + " AS penalty, "
    + _by_message("NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'ташкент'", "NULL", "NULL") + " AS location, "
    + _by_message("true", *["false"] * 8) + " AS remote, "
    + _by_message(*["CAST([] AS VARCHAR[])"] * 7, "['facebook ads']", "CAST([] AS VARCHAR[])") + " AS platforms FROM orders",
)
def scorer_exclusions(t):
    lex = scorer.ScorerLexicon()
    return order_messages(t).select(
        "o_orderkey",
        scorer.excluded_specialisation(_low(), lex).alias("excluded_specialisation"),
        scorer.exclusion_penalty(_low(), lex).alias("penalty"),
        scorer.first_match(_low(), lex.locations).alias("location"),
        scorer.any_pattern(_low(), lex.remote).alias("remote"),
        scorer.excluded_platforms(_low(), lex).alias("platforms"),
    )


@query(
    "scorer_agency",
    "SELECT o_orderkey, " + _by_message("false", "false", "false", "true", *["false"] * 5)
    + " AS is_agency, false AS needs_clarification FROM orders",
)
def scorer_agency(t):
    return order_messages(t).select("o_orderkey", scorer.agency(_low(), scorer.ScorerLexicon()).alias("a")).select(
        "o_orderkey", "a.is_agency", "a.needs_clarification"
    )


@query(
    "scorer_target_keywords",
    "SELECT o_orderkey, " + _by_message("'seo'", "'авито'", "'tilda'", "NULL", "'сайт'", "NULL", "'директ'", "NULL", "NULL")
    + " AS keyword FROM orders",
)
def scorer_target_keywords(t):
    return order_messages(t).select(
        "o_orderkey", scorer.target_keyword(_low(), scorer.ScorerLexicon()).alias("keyword")
    )


# Messages that hold an example of every pattern of the scorer's lists.
_LISTS = scorer.ScorerLexicon()
PATTERN_EXAMPLES = [
    examples.example(p)
    for patterns in (_LISTS.spam, _LISTS.offer, _LISTS.offer_overrides, _LISTS.demand, _LISTS.context, _LISTS.order_formats, _LISTS.locations,
                     _LISTS.platforms, _LISTS.agency, _LISTS.team, _LISTS.exclusions, _LISTS.remote, _LISTS.targets)
    for p in patterns
]


def pattern_messages(t):
    texts = F.array(*map(F.lit, PATTERN_EXAMPLES))
    some = lambda shift: F.get(texts, F.pmod(F.col("o_orderkey") + shift, F.lit(len(PATTERN_EXAMPLES))).cast("int"))
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.concat(F.lit("Добрый день, "), some(0), F.lit(", спасибо")))
        .when(status == "O", F.concat(some(0), F.lit(" и "), some(61)))
        .otherwise(F.concat(F.lit("Команда пишет: "), some(0), F.lit("! Ещё: "), some(17), F.lit("; "), some(140)))
    )
    return spread(t.orders).select("o_orderkey", F.lower(text).alias("text"))


def _sql_pattern(pattern: str) -> str:
    """The pattern in the other engine, whose word characters are ASCII: borders become the characters beside them."""
    word = r"\p{L}\p{N}_"
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|[^{word}]){pattern[2:]}"
    if pattern.endswith(r"\b"):
        pattern = f"{pattern[:-2]}(?:$|[^{word}])"
    return "(?i)" + pattern.replace(r"\w", f"[{word}]")


def _sql_any_pattern(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {_s(_sql_pattern(p))})" for p in patterns) + ")" if patterns else "false"


_PATTERN_MESSAGES = f"""
  words AS (SELECT [{", ".join(map(_s, PATTERN_EXAMPLES))}] AS w),
  picks AS (SELECT o_orderkey, o_orderstatus, w[o_orderkey % {len(PATTERN_EXAMPLES)} + 1] AS a, w[(o_orderkey + 61) % {len(PATTERN_EXAMPLES)} + 1] AS b,
                   w[(o_orderkey + 17) % {len(PATTERN_EXAMPLES)} + 1] AS c, w[(o_orderkey + 140) % {len(PATTERN_EXAMPLES)} + 1] AS d FROM orders, words),
  messages AS (SELECT o_orderkey, lower(CASE o_orderstatus WHEN 'F' THEN 'Добрый день, ' || a || ', спасибо' WHEN 'O' THEN a || ' и ' || b
                                        ELSE 'Команда пишет: ' || a || '! Ещё: ' || c || '; ' || d END) AS text FROM picks)"""


@query(
    "scorer_pattern_lists",
    f"""WITH {_PATTERN_MESSAGES}
        SELECT o_orderkey, {_sql_any_pattern(_LISTS.spam)} AS is_spam,
               {_sql_any_pattern(_LISTS.offer)} AND NOT {_sql_any_pattern(_LISTS.offer_overrides)} AS is_offer,
               CASE WHEN {_sql_any_pattern(_LISTS.demand)} THEN 2 ELSE 0 END AS demand,
               CASE WHEN {_sql_any_pattern(_LISTS.context)} THEN 3 ELSE 0 END AS context,
               CASE WHEN {_sql_any_pattern(_LISTS.order_formats)} THEN 2 ELSE 0 END AS order_format,
               -3 * ({" + ".join(f"{_sql_any_pattern([p])}::INT" for p in _LISTS.exclusions)}) AS penalty,
               {_sql_any_pattern(_LISTS.locations)} AS excluded_location, {_sql_any_pattern(_LISTS.remote)} AS remote,
               {" + ".join(f"{_sql_any_pattern([p])}::INT" for p in _LISTS.platforms)} AS platforms,
               {_sql_any_pattern(_LISTS.team)} AS team FROM messages""",
)
def scorer_pattern_lists(t):
    """The scorer's pattern lists on messages that hold an example of each of their patterns."""
    low = F.col("text")
    return pattern_messages(t).select(
        "o_orderkey",
        scorer.is_spam(low, _LISTS).alias("is_spam"),
        scorer.is_offer(low, _LISTS).alias("is_offer"),
        scorer.demand(low, _LISTS).alias("demand"),
        scorer.context(low, _LISTS).alias("context"),
        scorer.order_format(low, _LISTS).alias("order_format"),
        scorer.exclusion_penalty(low, _LISTS).alias("penalty"),
        scorer.first_match(low, _LISTS.locations).isNotNull().alias("excluded_location"),
        scorer.any_pattern(low, _LISTS.remote).alias("remote"),
        F.size(scorer.excluded_platforms(low, _LISTS)).alias("platforms"),
        scorer.any_pattern(low, _LISTS.team).alias("team"),
    )
