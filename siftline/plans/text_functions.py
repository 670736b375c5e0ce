"""Text functions over the driver tables.  The class cues here are Latin stand-ins; the functions are the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import classify, entities, numbers, similarity, text as T
from siftline.plans.registry import query
from siftline.session import spread

# The same classes in RE2, for the SQL side.
SQL_WORD = r"\p{L}\p{N}_"
SQL_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
SQL_CLEAN = rf"regexp_replace(lower(text), '[^{SQL_WORD}{SQL_SPACE}]', '', 'g')"

PRICING = ["license", "free"]
REQUEST = ["token", "threat", "worthless"]
GREETING = ["les ", "und "]
POSITIVE = ["thanedble", "bien"]
NEGATIVE = ["nicht", "pathetic", "scum"]
HURRY = ["idiot", "disgusting"]
DETAIL = ["hetition", "thintion"]


def sql_any(column: str, cues) -> str:
    return "(" + " OR ".join(f"contains({column}, '{c}')" for c in cues) + ")"


_LOOKALIKE_SQL = f"translate(nfc_normalize(text), '{''.join(T.LOOKALIKES)}', '{''.join(T.LOOKALIKES.values())}')"


@query("fn_normalize_unicode", f"SELECT doc_id, md5({_LOOKALIKE_SQL}) AS norm_key FROM documents")
def fn_normalize_unicode(t):
    return t.texts.select("doc_id", F.md5(T.normalize_unicode(F.col("text"))).alias("norm_key"))


@query(
    "fn_homoglyph_fold",
    f"SELECT doc_id, md5(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}')) AS folded_key FROM documents",
)
def fn_homoglyph_fold(t):
    return t.documents.select("doc_id", F.md5(T.fold_homoglyphs(F.col("text"))).alias("folded_key"))


@query("fn_urls", "SELECT page_id, regexp_extract_all(url || ' ' || html, 'https?://[a-z$-_!]+') AS urls FROM pages")
def fn_urls(t):
    return t.pages.select("page_id", T.urls(F.concat_ws(" ", "url", "html")).alias("urls"))


@query(
    "fn_domains",
    """SELECT page_id, list_transform(regexp_extract_all(url || ' ' || html, 'https?://[a-z$-_!]+'),
              lambda u: regexp_extract(u, '^https?://([^/?#]*)', 1)) AS domains FROM pages""",
)
def fn_domains(t):
    return t.pages.select("page_id", T.domains(T.urls(F.concat_ws(" ", "url", "html"))).alias("domains"))


@query(
    "fn_emoji_runs",
    f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[{T.EMOJI_BLOCKS}]+')) AS runs,
                          len(regexp_extract_all({SQL_CLEAN}, '[^{SQL_SPACE}]+')) AS words FROM documents)
        SELECT doc_id, CAST(runs AS INTEGER) AS emoji_runs,
               CASE WHEN words > 0 THEN round(runs / words, 6)::DOUBLE ELSE 0.0::DOUBLE END AS emoji_density FROM c""",
)
def fn_emoji_runs(t):
    runs = T.emoji_runs(F.col("text"))
    share = T.density(runs, T.word_count(F.lower("text")))
    return t.documents.select("doc_id", runs.alias("emoji_runs"), F.round(share, 6).alias("emoji_density"))


@query("fn_hashtags", f"SELECT doc_id, regexp_extract_all(lower(text), '#[{SQL_WORD}]+') AS hashtags FROM documents")
def fn_hashtags(t):
    return t.documents.select("doc_id", T.hashtags(F.lower("text")).alias("hashtags"))


@query("fn_mentions", f"SELECT doc_id, regexp_extract_all(text, '@[{SQL_WORD}]+') AS mentions FROM documents")
def fn_mentions(t):
    return t.documents.select("doc_id", T.mentions(F.col("text")).alias("mentions"))


@query(
    "fn_word_count",
    f"SELECT doc_id, CAST(len(regexp_extract_all({SQL_CLEAN}, '[^{SQL_SPACE}]+')) AS INTEGER) AS word_count FROM documents",
)
def fn_word_count(t):
    return t.texts.select("doc_id", T.word_count(F.lower("text")).alias("word_count"))


@query(
    "fn_caps_ratio",
    r"""SELECT doc_id, round(CASE WHEN length(text) > 0
               THEN len(regexp_extract_all(text, '\p{Lu}')) / length(text) ELSE 0 END, 6)::DOUBLE AS caps_ratio
        FROM documents""",
)
def fn_caps_ratio(t):
    return t.documents.select("doc_id", F.round(T.caps_ratio(F.col("text")), 6).alias("caps_ratio"))


@query(
    "fn_budget_mentions",
    rf"""WITH b AS (SELECT p_partkey, list_transform(regexp_extract_all(
                      p_name || ' ' || p_size || ' rub, ' || CAST(floor(p_retailprice) AS BIGINT) || ' usd',
                      '(\d+)[{SQL_SPACE}]*(?:{T.CURRENCY})', 1), lambda n: CAST(n AS BIGINT)) AS budget_values FROM part)
        SELECT p_partkey, budget_values, round(coalesce(list_avg(budget_values), 0), 6)::DOUBLE AS avg_budget FROM b""",
)
def fn_budget_mentions(t):
    offer = F.concat(
        "p_name", F.lit(" "), "p_size", F.lit(" rub, "), F.floor("p_retailprice"), F.lit(" usd")
    )
    values = T.budget_values(F.lower(offer))
    return t.part.select(
        "p_partkey", values.alias("budget_values"), F.round(T.array_mean(values), 6).alias("avg_budget")
    )


@query(
    "fn_text_hash",
    f"SELECT doc_id, md5(regexp_replace(lower(text), '[{SQL_SPACE}]+', '', 'g')) AS hash FROM documents",
)
def fn_text_hash(t):
    return t.documents.select("doc_id", T.text_hash(F.col("text")).alias("hash"))


_FINGERPRINT = (
    r"md5(trim(regexp_replace(regexp_replace(lower(text), '[\x{10000}-\x{10FFFF}]', '', 'g'), "
    rf"'[{SQL_SPACE}]+', ' ', 'g')))"
)


@query("fn_dedup_fingerprint", f"SELECT doc_id, {_FINGERPRINT} AS fingerprint FROM documents")
def fn_dedup_fingerprint(t):
    return t.documents.select("doc_id", T.dedup_fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "fn_cache_key",
    "SELECT conv_id, turn, md5(role || '||' || text) AS cache_key FROM conversations",
)
def fn_cache_key(t):
    return t.conversations.select("conv_id", "turn", T.cache_key(F.col("role"), F.col("text")).alias("cache_key"))


@query(
    "fn_clean_text",
    f"""SELECT doc_id, md5(regexp_replace({SQL_CLEAN}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')) AS clean_key
        FROM documents""",
)
def fn_clean_text(t):
    return t.documents.select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_key"))


@query(
    "fn_keywords",
    f"""SELECT conv_id, turn, list_filter(regexp_extract_all({SQL_CLEAN}, '[^{SQL_SPACE}]+'),
               lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'les', 'des', 'die', 'und', 'que')) AS keywords
        FROM conversations""",
)
def fn_keywords(t):
    stop = ["the", "and", "les", "des", "die", "und", "que"]
    return t.conversations.select("conv_id", "turn", T.keywords(F.col("text"), stop).alias("keywords"))


@query(
    "fn_text_to_number",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000
              ELSE 25000 END AS number FROM orders""",
)
def fn_text_to_number(t):
    """Order keys written as Russian amounts and read back."""
    amount = F.floor(F.col("o_totalprice") / 1000)
    written = F.when(F.col("o_orderstatus") == "F", F.concat(amount, F.lit(" тыс"))).when(
        F.col("o_orderstatus") == "O", F.concat(amount, F.lit("к"))
    ).otherwise(F.concat(F.lit("двадцать пять тысяч и "), amount))
    return t.orders.select("o_orderkey", numbers.text_to_number(written).alias("number"))


@query(
    "fn_budget_range",
    """SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS min, (CAST(p_size AS BIGINT) + 10) * 1000 AS max FROM part""",
)
def fn_budget_range(t):
    phrase = F.concat(F.lit("Бюджет от "), "p_size", F.lit(" до "), F.col("p_size") + 10, F.lit(" тысяч"))
    spans = t.part.select("p_partkey", numbers.budget_range(phrase).alias("r"))
    return spans.select("p_partkey", "r.min", "r.max")


@query(
    "fn_deadline_date",
    """SELECT event_id, CASE event_type WHEN 'error' THEN ts WHEN 'view' THEN ts + INTERVAL 1 DAY
              WHEN 'click' THEN ts + INTERVAL 2 DAY WHEN 'purchase' THEN ts + INTERVAL 21 DAY
              ELSE ts + (CASE WHEN isodow(ts) = 7 THEN 7 ELSE 7 - isodow(ts) END) * INTERVAL 1 DAY END AS deadline
       FROM events""",
)
def fn_deadline_date(t):
    kind = F.col("event_type")
    phrase = (
        F.when(kind == "error", "Срочно!").when(kind == "view", "сделать завтра")
        .when(kind == "click", "можно послезавтра").when(kind == "purchase", "через три недели")
        .otherwise("до конца недели")
    )
    return t.events.select("event_id", numbers.deadline(phrase, F.col("ts")).cast("timestamp_ntz").alias("deadline"))


@query(
    "fn_entity_budget",
    """SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS min, (CAST(p_size AS BIGINT) + 5) * 1000 AS max,
              '₽' AS currency FROM part""",
)
def fn_entity_budget(t):
    phrase = F.concat(F.lit("Бюджет: от "), "p_size", F.lit(" до "), F.col("p_size") + 5, F.lit(" тыс"))
    return t.part.select("p_partkey", numbers.entity_budget(phrase).alias("b")).select(
        "p_partkey", "b.min", "b.max", "b.currency"
    )


@query(
    "fn_entity_deadline",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'urgent' WHEN 'view' THEN 'asap' WHEN 'click' THEN 'today'
              WHEN 'purchase' THEN 'specific_date' END AS urgency FROM events""",
)
def fn_entity_deadline(t):
    kind = F.col("event_type")
    phrase = (
        F.when(kind == "error", "Очень срочно, сегодня").when(kind == "view", "нужно ASAP")
        .when(kind == "click", "сегодня или завтра").when(kind == "purchase", "до 5 мая").otherwise("когда-нибудь")
    )
    return t.events.select("event_id", numbers.entity_urgency(phrase).alias("urgency"))


@query(
    "fn_contact_spans",
    rf"""SELECT doc_id, regexp_extract_all(text, '{entities.EMAIL}') AS emails,
               regexp_extract_all(text, '{entities.PHONE}') AS phones,
               regexp_extract_all(text, '{entities.HANDLE}', 1) AS handles,
               md5(regexp_replace(regexp_replace(regexp_replace(text, '{entities.EMAIL}', '<email>', 'g'),
                   '{entities.PHONE}', '<phone>', 'g'), '{entities.HANDLE}', '<handle>', 'g')) AS masked_key
        FROM documents""",
)
def fn_contact_spans(t):
    """Personal data found in the documents, and the documents with it masked."""
    return t.texts.select(
        "doc_id",
        entities.contact_spans(F.col("text")).alias("c"),
        F.md5(entities.mask_contacts(F.col("text"))).alias("masked_key"),
    ).select("doc_id", "c.emails", "c.phones", "c.handles", "masked_key")


@query(
    "fn_company_names",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['Ромашка ' || o_custkey] WHEN 'O' THEN ['Новый Дом']
              ELSE [] END AS companies FROM orders""",
)
def fn_company_names(t):
    status = F.col("o_orderstatus")
    phrase = (
        F.when(status == "F", F.concat(F.lit("компания «Ромашка "), "o_custkey", F.lit("» ищет")))
        .when(status == "O", "сайт для Новый Дом и не только").otherwise("просто текст")
    )
    return t.orders.select("o_orderkey", entities.company_names(phrase).alias("companies"))


@query(
    "fn_entities_hybrid",
    """SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS budget_min, CAST('named_amount' AS VARCHAR) AS method
       FROM part WHERE p_type = 'PROMO'
       UNION ALL SELECT p_partkey, CAST(p_size AS BIGINT), 'pattern' FROM part WHERE p_type <> 'PROMO'""",
)
def fn_entities_hybrid(t):
    phrase = F.when(
        F.col("p_type") == "PROMO", F.concat(F.lit("бюджет примерно "), "p_size", F.lit(" тыс"))
    ).otherwise(F.concat(F.lit("бюджет: "), "p_size", F.lit(" руб")))
    return t.part.select("p_partkey", entities.hybrid(phrase).alias("h")).select("p_partkey", "h.budget_min", "h.method")


def message_contacts(t):
    """Customers as message senders: some name a contact in the text, some only have a name or an id."""
    segment = F.col("c_mktsegment")
    handle = F.concat(F.lit("@user_"), "c_custkey")
    text = (
        F.when(segment == "BUILDING", F.concat(F.lit("Пишите в личку "), handle))
        .when(segment == "MACHINERY", "подробности в личные сообщения")
        .when(segment == "FURNITURE", "нужен спец, есть такие?").otherwise("нужен спец")
    )
    buttons = F.when(
        segment == "AUTOMOBILE",
        F.concat(F.lit("🔘 КНОПКИ:\n• Сайт → https://example.com\n• Написать автору → https://t.me/auto"), "c_custkey"),
    )
    name = F.when(segment == "FURNITURE", F.col("c_name"))
    fwd = F.lit(None).cast("struct<from_id:bigint,from_username:string,channel_id:bigint>")
    return spread(t.customer).select(
        "c_custkey",
        entities.contact_priority(text, buttons, name, F.col("c_custkey") + 1, fwd).alias("contact"),
        entities.parse_buttons(buttons).alias("buttons"),
    )


@query(
    "fn_contact_priority",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '1B' WHEN 'MACHINERY' THEN '1C' WHEN 'AUTOMOBILE' THEN '1A'
              WHEN 'FURNITURE' THEN '2' ELSE '3' END AS priority_level,
              CASE c_mktsegment WHEN 'BUILDING' THEN '@user_' || c_custkey WHEN 'MACHINERY' THEN 'написать автору/админу'
              WHEN 'AUTOMOBILE' THEN '@auto' || c_custkey WHEN 'FURNITURE' THEN '@' || c_name
              ELSE CAST(c_custkey + 1 AS VARCHAR) END AS contact_value FROM customer""",
)
def fn_contact_priority(t):
    return message_contacts(t).select("c_custkey", "contact.priority_level", "contact.contact_value")


@query(
    "fn_parse_buttons",
    """SELECT c_custkey, 'Написать автору' AS best_text, 'https://t.me/auto' || c_custkey AS best_url,
              CAST(2 AS INTEGER) AS buttons FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""",
)
def fn_parse_buttons(t):
    parsed = message_contacts(t).filter(F.size("buttons") > 0)
    return parsed.select(
        "c_custkey",
        F.col("buttons")[0]["text"].alias("best_text"),
        F.col("buttons")[0]["url"].alias("best_url"),
        F.size("buttons").alias("buttons"),
    )


@query(
    "fn_username_from_url",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '@user_' || c_custkey
              WHEN c_mktsegment = 'MACHINERY' THEN '@Customer' WHEN c_mktsegment = 'FURNITURE' THEN '@direct' END AS username
       FROM customer""",
)
def fn_username_from_url(t):
    segment = F.col("c_mktsegment")
    url = (
        F.when(segment == "BUILDING", F.concat(F.lit("https://t.me/user_"), "c_custkey"))
        .when(segment == "MACHINERY", F.concat(F.lit("http://Telegram.me/"), "c_name"))
        .when(segment == "FURNITURE", "@direct").otherwise(F.concat(F.lit("https://example.com/"), "c_name"))
    )
    return t.customer.select("c_custkey", entities.username_from_url(url).alias("username"))


@query(
    "fn_niche",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'медицина' WHEN 'O' THEN 'строительство' END AS niche,
              CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'none' END AS confidence FROM orders""",
)
def fn_niche(t):
    status = F.col("o_orderstatus")
    phrase = (
        F.when(status == "F", "Проект в нише стоматология и клиника, срочно")
        .when(status == "O", "Построим коттедж, ремонт под ключ").otherwise("Привет всем")
    )
    return t.orders.select("o_orderkey", entities.niche(phrase).alias("n")).select(
        "o_orderkey", F.col("n.name").alias("niche"), "n.confidence"
    )


@query(
    "fn_budget_strings",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL ELSE p_size || ' тыс' END AS money FROM part""",
)
def fn_budget_strings(t):
    phrase = F.when(F.col("p_size") < 10, "без денег").otherwise(F.concat(F.lit("от "), "p_size", F.lit(" тыс")))
    return t.part.select("p_partkey", numbers.money_strings(phrase).alias("money"))


@query(
    "fn_freshness_bonus",
    """SELECT event_id, CASE WHEN TIMESTAMP '2024-01-31' - ts <= INTERVAL 3 DAY THEN 1
              WHEN TIMESTAMP '2024-01-31' - ts <= INTERVAL 7 DAY THEN 0
              WHEN TIMESTAMP '2024-01-31' - ts <= INTERVAL 14 DAY THEN -1 ELSE -2 END AS bonus FROM events""",
)
def fn_freshness_bonus(t):
    now = F.expr("TIMESTAMP_NTZ '2024-01-31'")
    return t.events.select("event_id", classify.freshness_bonus(F.col("ts"), now).alias("bonus"))


_INTENT = f"""CASE WHEN {sql_any('c', PRICING)} THEN 'pricing_inquiry' WHEN {sql_any('c', REQUEST)} THEN 'service_request'
                   WHEN {sql_any('c', GREETING)} THEN 'greeting' ELSE 'general_inquiry' END"""
_CLEANED = f"SELECT doc_id, {SQL_CLEAN} AS c FROM documents"
INTENT_CUES = [("pricing_inquiry", PRICING), ("service_request", REQUEST), ("greeting", GREETING)]
CATEGORY_CUES = [("german", ["und ", "nicht"]), ("french", ["les ", "une "]), ("spanish", ["ción", " que "])]


@query("fn_intent", f"SELECT doc_id, {_INTENT} AS intent FROM ({_CLEANED})")
def fn_intent(t):
    return t.documents.select("doc_id", classify.intent(T.clean_text(F.col("text")), INTENT_CUES).alias("intent"))


_CATEGORY = f"""CASE WHEN {sql_any('c', CATEGORY_CUES[0][1])} THEN 'german' WHEN {sql_any('c', CATEGORY_CUES[1][1])}
                THEN 'french' WHEN {sql_any('c', CATEGORY_CUES[2][1])} THEN 'spanish' ELSE 'english' END"""


@query("fn_category", f"SELECT doc_id, {_CATEGORY} AS category FROM ({_CLEANED})")
def fn_category(t):
    low = T.clean_text(F.col("text"))
    return t.documents.select("doc_id", classify.category(low, CATEGORY_CUES, "english").alias("category"))


_TONE = f"""CASE WHEN {sql_any('c', POSITIVE)} THEN 'positive' WHEN {sql_any('c', NEGATIVE)} THEN 'negative'
            ELSE 'neutral' END || CASE WHEN {sql_any('c', HURRY)} THEN '_hurry' ELSE '' END"""


@query("fn_tone", f"SELECT doc_id, {_TONE} AS tone FROM ({_CLEANED})")
def fn_tone(t):
    low = T.clean_text(F.col("text"))
    return t.documents.select("doc_id", classify.tone(low, POSITIVE, NEGATIVE, HURRY).alias("tone"))


@query(
    "fn_message_score",
    f"""SELECT doc_id, (3.0 + CASE WHEN {_INTENT} = 'service_request' THEN 3.0 ELSE 0.0 END
               + CASE WHEN {_CATEGORY} <> 'english' THEN 2.0 ELSE 0.0 END
               + CASE WHEN {sql_any('c', DETAIL)} THEN 2.0 ELSE 0.0 END)::DOUBLE AS score FROM ({_CLEANED})""",
)
def fn_message_score(t):
    low = T.clean_text(F.col("text"))
    what, topic = classify.intent(low, INTENT_CUES), classify.category(low, CATEGORY_CUES, "english")
    return t.documents.select(
        "doc_id", classify.message_score(what, topic, low, DETAIL, "english").alias("score")
    )


@query(
    "fn_message_entities",
    r"""SELECT page_id, regexp_extract(msg, 'https?://[^\s]+') AS url, page_id * 10 AS budget
        FROM (SELECT page_id, 'see ' || url || ' for ' || page_id * 10 || ' usd' AS msg FROM pages)""",
)
def fn_message_entities(t):
    message = F.concat(F.lit("see "), "url", F.lit(" for "), F.col("page_id") * 10, F.lit(" usd"))
    return t.pages.select("page_id", classify.message_entities(message).alias("e")).select("page_id", "e.url", "e.budget")


STRONG, WEAK = ["mit license", "threatthe"], ["that ", "tion ", "ingre"]


@query(
    "fn_bot_autoreply",
    f"""SELECT doc_id, {sql_any('lower(text)', STRONG)}
               OR (contains(lower(text), 'that ')::INT + contains(lower(text), 'tion ')::INT
                   + contains(lower(text), 'ingre')::INT) >= 2
               OR regexp_matches(lower(text), 'id\\s*:\\s*[a-z0-9/ ]{{10,}}') AS is_autoreply FROM documents""",
)
def fn_bot_autoreply(t):
    return t.documents.select("doc_id", classify.bot_autoreply(F.col("text"), STRONG, WEAK).alias("is_autoreply"))


def _leak_sql() -> str:
    whens = " ".join(
        "WHEN contains(lower(text), '{}') THEN '{}'".format(p.replace("'", "''"), r.replace("'", "''"))
        for p, r in classify.dialog.LEAK_PHRASES
    )
    return f"""SELECT doc_id, CASE WHEN reason IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS verdict,
                      coalesce(reason, 'Quick check passed') AS reason
               FROM (SELECT doc_id, CASE {whens} END AS reason FROM documents)"""


@query("fn_tech_leak_check", _leak_sql())
def fn_tech_leak_check(t):
    return t.texts.select("doc_id", classify.leak_check(F.col("text")).alias("v")).select(
        "doc_id", "v.verdict", "v.reason"
    )


@query(
    "fn_emotion_state",
    f"""WITH m AS (SELECT conv_id, turn, text, role, turn + 1 AS n, {SQL_CLEAN} AS c FROM conversations),
             x AS (SELECT *, {_TONE} AS tone, {_CATEGORY} AS category FROM m)
        SELECT conv_id, turn, CASE WHEN contains(tone, 'hurry') OR {sql_any('lower(text)', HURRY)} THEN 'interested'
             WHEN role = 'system' AND n <= 3 THEN 'intrigued'
             WHEN {sql_any('lower(text)', PRICING)} AND n >= 3 THEN 'intrigued'
             WHEN tone = 'negative' AND n > 0 THEN 'skeptical'
             WHEN tone = 'positive' OR (n > 5 AND tone <> 'negative') THEN 'interested'
             WHEN n > 8 THEN 'tired' WHEN category <> 'english' THEN 'uncertain'
             WHEN ends_with(trim(text), '?') AND n >= 2 THEN 'intrigued' ELSE 'skeptical' END AS emotion FROM x""",
)
def fn_emotion_state(t):
    low = T.clean_text(F.col("text"))
    state = classify.emotion(
        F.col("text"),
        classify.tone(low, POSITIVE, NEGATIVE, HURRY),
        F.col("turn") + 1,
        F.col("role") == "system",
        classify.category(low, CATEGORY_CUES, "english"),
        HURRY,
        PRICING,
        ["english"],
    )
    return t.conversations.select("conv_id", "turn", state.alias("emotion"))


@query(
    "fn_tag_extract",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'turn ' || turn END AS question,
              md5(trim(text)) AS clean_key FROM conversations""",
)
def fn_tag_extract(t):
    body = F.col("text")
    marked = F.when(
        F.col("role") == "assistant", F.concat(body, F.lit(" [ASK_ADMIN: turn "), "turn", F.lit("]"))
    ).otherwise(body)
    return t.conversations.select("conv_id", "turn", classify.tag_extract(marked, "ASK_ADMIN", "?").alias("x")).select(
        "conv_id", "turn", F.col("x.content").alias("question"), F.md5(F.trim("x.text")).alias("clean_key")
    )


@query(
    "fn_json_salvage",
    """SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'BUYER' ELSE 'SELLER' END AS result,
              CASE WHEN toxic = 1 THEN 'toxic' ELSE 'fine' END AS reason FROM labels""",
)
def fn_json_salvage(t):
    """Labels rendered as fenced, trailing-comma and unquoted model output, and read back."""
    verdict = F.when(F.col("quality") == 1, "BUYER").otherwise("SELLER")
    why = F.when(F.col("toxic") == 1, "toxic").otherwise("fine")
    good = F.format_string('```json\n[{"id": %d, "result": "%s", "reason": "%s", "marker": ""},]\n```', "doc_id", verdict, why)
    bad = F.format_string("Result: [{id: %d, result: %s, reason: %s}]", "doc_id", verdict, why)
    raw = F.when(F.col("toxic") == 1, bad).otherwise(good)
    parsed = t.labels.select(F.explode(classify.json_salvage(raw)).alias("o"))
    return parsed.select("o.id", "o.result", "o.reason")


@query(
    "fn_age_class",
    """SELECT event_id, CASE WHEN TIMESTAMP '2024-01-31' - ts > INTERVAL 3 DAY THEN 'follow_up'
              WHEN TIMESTAMP '2024-01-31' - ts > INTERVAL 12 HOUR THEN 'old' ELSE 'fresh' END AS age FROM events""",
)
def fn_age_class(t):
    return t.events.select(
        "event_id", classify.age_class(F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-31'")).alias("age")
    )


@query(
    "fn_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
       FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""",
)
def fn_cosine(t):
    """Each vector against the next one."""
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(following, "vec_id").select(
        "vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


def consecutive_turns(t):
    turns = t.conversations.select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(after, ["conv_id", "turn"])


@query("fn_sequence_ratio")
def fn_sequence_ratio(t):
    return consecutive_turns(t).select(
        "conv_id", "turn", F.round(similarity.sequence_ratio("text", "reply"), 6).alias("ratio")
    )


_TURN_SHINGLES = (
    r"list_distinct(list_transform(generate_series(1, length({c}) - 2), lambda i: substr({c}, i::BIGINT, 3)))"
)


@query(
    "fn_jaccard",
    rf"""WITH p AS (SELECT a.conv_id, a.turn,
                     regexp_replace(lower(a.text), '[^\p{{L}}\p{{N}}{SQL_SPACE}]', '', 'g') AS x,
                     regexp_replace(lower(b.text), '[^\p{{L}}\p{{N}}{SQL_SPACE}]', '', 'g') AS y
                   FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
              s AS (SELECT conv_id, turn, {_TURN_SHINGLES.format(c='x')} AS sx, {_TURN_SHINGLES.format(c='y')} AS sy FROM p)
         SELECT conv_id, turn, round(CASE WHEN len(sx) = 0 OR len(sy) = 0 THEN 0 ELSE
                len(list_intersect(sx, sy)) / len(list_distinct(list_concat(sx, sy))) END, 6)::DOUBLE AS jaccard FROM s""",
)
def fn_jaccard(t):
    codes = similarity.shingle_codes(3)
    return (
        consecutive_turns(t)
        .select("conv_id", "turn", codes("text").alias("a"), codes("reply").alias("b"))
        .select("conv_id", "turn", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))
    )


@query(
    "fn_output_clean",
    f"""WITH c AS (SELECT conv_id, turn, trim(translate(text, '"''«»“”', '')) AS x FROM conversations)
        SELECT conv_id, turn, md5(x) AS clean_key,
               {sql_any('lower(x)', ['threat', 'scum'])} AND length(x) < 200 AS is_failure FROM c""",
)
def fn_output_clean(t):
    return t.conversations.select(
        "conv_id", "turn", classify.output_clean(F.col("text"), ["threat", "scum"]).alias("o")
    ).select("conv_id", "turn", F.md5("o.text").alias("clean_key"), "o.is_failure")
