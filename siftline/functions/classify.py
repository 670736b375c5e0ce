"""Intent, category, tone and other verdicts over single messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import clean_text, extract_all, let
from siftline.lexicons import dialog
from siftline.operators.filters import keyword_pattern


def has_any(low: Column, cues: Sequence[str]) -> Column:
    """Whether a lower-cased text contains any cue; one scan of the text."""
    return F.coalesce(low.rlike(keyword_pattern(cues).replace("(?iu)", "")), F.lit(False))


def first_class(low: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    result = F.when(F.lit(False), F.lit(default))
    for label, cues in classes:
        result = result.when(has_any(low, cues), F.lit(label))
    return result.otherwise(F.lit(default))


INTENTS = [
    ("pricing_inquiry", dialog.PRICING),
    ("service_request", dialog.REQUEST),
    ("greeting", dialog.GREETING),
]
CATEGORIES = [
    ("таргет вк", dialog.CATEGORY_VK),
    ("SEO", dialog.CATEGORY_SEO),
    ("авито", dialog.CATEGORY_AVITO),
    ("разработка сайтов", dialog.CATEGORY_SITES),
    ("контекстная реклама", dialog.CATEGORY_CONTEXT),
]
DEFAULT_CATEGORY = "маркетинг"


def intent(low: Column, classes=INTENTS) -> Column:
    return first_class(low, classes, "general_inquiry")


def category(low: Column, classes=CATEGORIES, default: str = DEFAULT_CATEGORY) -> Column:
    return first_class(low, classes, default)


def tone(low: Column, positive=dialog.POSITIVE, negative=dialog.NEGATIVE, hurry=dialog.HURRY) -> Column:
    base = first_class(low, [("positive", positive), ("negative", negative)], "neutral")
    return F.concat(base, F.when(has_any(low, hurry), "_hurry").otherwise(""))


def message_score(
    intent_: Column, category_: Column, low: Column, detail=dialog.DETAIL, default: str = DEFAULT_CATEGORY
) -> Column:
    return (
        F.lit(3.0)
        + F.when(intent_ == "service_request", 3.0).otherwise(0.0)
        + F.when(category_ != default, 2.0).otherwise(0.0)
        + F.when(has_any(low, detail), 2.0).otherwise(0.0)
    )


def message_entities(text: Column) -> Column:
    """First URL and first budget, read from the raw text."""
    url, budget = r"https?://[^\s]+", r"(\d+)\s*(?:руб|р|usd|\$)"
    low = F.lower(text)
    return F.struct(
        F.when(text.rlike(url), F.regexp_extract(text, url, 0)).alias("url"),
        F.when(low.rlike(budget), F.regexp_extract(low, budget, 1).try_cast("long")).alias("budget"),
    )


def classify(text: Column) -> Column:
    low = clean_text(text)
    what, topic = intent(low), category(low)
    return F.struct(
        what.alias("intent"),
        topic.alias("category"),
        tone(low).alias("tone"),
        message_score(what, topic, low).alias("score"),
        message_entities(text).alias("entities"),
    )


def bot_autoreply(
    text: Column, strong=dialog.AUTOREPLY_STRONG, weak=dialog.AUTOREPLY_WEAK
) -> Column:
    low = F.lower(text)
    weak_hits = let(low, lambda t: F.size(F.filter(F.array(*map(F.lit, weak)), lambda p: F.contains(t, p))))
    return has_any(low, strong) | (weak_hits >= 2) | F.coalesce(low.rlike(r"id\s*:\s*[a-z0-9/ ]{10,}"), F.lit(False))


def first_phrase(low: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Reason of the first listed phrase the text contains, or null."""
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(r).alias("reason")) for p, r in phrases])
    return let(low, lambda t: F.get(F.filter(table, lambda e: F.contains(t, e["phrase"])), 0)["reason"])


def leak_check(text: Column, phrases=dialog.LEAK_PHRASES) -> Column:
    reason = first_phrase(F.lower(text), phrases)
    return F.struct(
        F.when(reason.isNotNull(), "BLOCK").otherwise("ALLOW").alias("verdict"),
        F.coalesce(reason, F.lit("Quick check passed")).alias("reason"),
        F.when(reason.isNotNull(), 0.99).otherwise(0.0).alias("confidence"),
    )


# Cues and categories of the emotion rules.
EMOTION_HURRY = ["срочно", "быстро"]
EMOTION_PRICE = ["сколько стоит", "цена", "прайс", "бюджет", "стоимость"]
EMOTION_KNOWN = ["seo", "ppc", "avito", "smm", "marketing", "general"]


def emotion(
    text: Column, tone_: Column, messages: Column, outreach: Column, category_: Column,
    hurry=EMOTION_HURRY, price=EMOTION_PRICE, known=EMOTION_KNOWN,
) -> Column:
    low = F.lower(text)
    return (
        F.when(F.contains(tone_, F.lit("hurry")) | has_any(low, hurry), "interested")
        .when(outreach & (messages <= 3), "intrigued")
        .when(has_any(low, price) & (messages >= 3), "intrigued")
        .when((tone_ == "negative") & (messages > 0), "skeptical")
        .when((tone_ == "positive") | ((messages > 5) & (tone_ != "negative")), "interested")
        .when(messages > 8, "tired")
        .when(category_.isNotNull() & ~category_.isin(*known), "uncertain")
        .when(F.trim(text).endswith("?") & (messages >= 2), "intrigued")
        .otherwise("skeptical")
    )


def tag_extract(text: Column, tag: str, default: str) -> Column:
    """Content of a ``[TAG: ...]`` mark and the text without it."""
    pattern = rf"\[{tag}:\s*(.*?)\]"
    present = F.contains(text, F.lit(f"[{tag}:"))
    return F.struct(
        F.when(present, F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(default)).alias(
            "content"
        ),
        F.when(present, F.trim(F.regexp_replace(text, rf"\[{tag}:.*?\]", ""))).otherwise(text).alias("text"),
    )


VERDICTS = "array<struct<id:bigint,result:string,reason:string,marker:string>>"


def json_salvage(raw: Column) -> Column:
    """Verdict objects from model output: fences cut, outermost list parsed, trailing commas repaired,
    broken lists rescued object by object."""
    body = F.regexp_replace(raw, r"```(?:json)?\s*|\s*```", "")
    body = F.when(body.rlike(r"(?s)\[.*\]"), F.regexp_extract(body, r"(?s)\[.*\]", 0)).otherwise(body)
    repaired = F.regexp_replace(body, r",\s*([\]}])", "$1")
    parsed = F.from_json(repaired, VERDICTS, {"mode": "PERMISSIVE"})
    whole = F.when(
        (F.size(parsed) > 0) & F.forall(parsed, lambda o: o["id"].isNotNull() & o["result"].isNotNull()), parsed
    )
    objects = extract_all(body, r"(?is)\{[^{}]*\"?id\"?:\s*\d+[^{}]*\"?result\"?:\s*\"?\w+[^{}]*\}?")

    def field(o, name, value):
        return F.regexp_extract(o, rf"(?is)\"?{name}\"?:\s*{value}", 1)

    def rescue(o):
        return F.struct(
            field(o, "id", r"(\d+)").try_cast("bigint").alias("id"),
            F.upper(field(o, "result", r"\"?(\w+)")).alias("result"),
            F.trim(field(o, "reason", r"\"?([^\",}]*)")).alias("reason"),
            F.trim(field(o, "marker", r"\"?([^\",}]*)")).alias("marker"),
        )

    return F.coalesce(whole, F.transform(objects, rescue))


def age_class(ts: Column, now: Column) -> Column:
    age = now - ts
    return (
        F.when(age > F.expr("INTERVAL 3 DAY"), "follow_up")
        .when(age > F.expr("INTERVAL 12 HOUR"), "old")
        .otherwise("fresh")
    )


def freshness_bonus(ts: Column, now: Column) -> Column:
    age = now - ts
    return (
        F.when(age <= F.expr("INTERVAL 3 DAY"), 1)
        .when(age <= F.expr("INTERVAL 7 DAY"), 0)
        .when(age <= F.expr("INTERVAL 14 DAY"), -1)
        .otherwise(-2)
    )


# Quote characters that are removed and phrases of a failed generation.
QUOTES = "\"'«»“”"
FAILURES = [
    "provider returned error", "rate limit", "quota exceeded", "upstream error", "capacity reached", "error:",
    "exception:",
]


def output_clean(text: Column, failures=FAILURES) -> Column:
    """Generated text without quotes (JSON is left alone), and whether it is a short error message."""
    bare = F.trim(text)
    is_json = bare.startswith("{") | bare.startswith("[")
    clean = F.trim(F.when(is_json, text).otherwise(F.translate(text, QUOTES, "")))
    return F.struct(
        clean.alias("text"), (has_any(F.lower(clean), failures) & (F.length(clean) < 200)).alias("is_failure")
    )
