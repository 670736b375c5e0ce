"""Second, independent scorer: ordered rejections, then an additive relevance score."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import classify, literals, numbers
from siftline.functions import text as T
from siftline.lexicons import ru_scorer as ru

RE = "(?iU)"


def _flags(pattern: str) -> str:
    """Flags for lower-cased text: ignoring case costs time on every character, so only where it matters."""
    return RE if re.search(r"[A-ZА-ЯЁІЇЄҐ]", re.sub(r"\\.|\(\?[a-zA-Z]+\)", "", pattern)) else "(?U)"

# Patterns that live outside the lexicon lists.
BLOCKED_ROLE = (
    r"помощник|ассистент|(?<!seo[- ])автор|(?<!seo[- ])редактор|(?<!seo[- ])копирайтер|бизнесассистент|сценарист"
    r"|продюсер|продюссер|администратор|smm|смм|техспец|куратор|продажник|менеджер по продажам|sales manager|эксперт"
    r"|таргетолог|таргет|facebook|instagram|фейсбук|инстаграм|(?<!\w)fb(?!\w)|(?<!\w)ig(?!\w)|event[- ]агентство"
    r"|маркетинговое агентство|аккаунт.*авито|отзыв(?:ы|ов).*авито|посев(?:ы|ам)|коротк(?:ие|их) ролик(?:и|ов)|reels"
    r"|рилс|риллс|shorts|клониров(?:ать|ание) голос(а)?|татьяна мелехова|сертифицированн|#услуги|#сценарист|#продюсер"
    r"|#продюссер|#резюме|#ищуработу"
)
OFFER_OVERRIDES = [
    r"\bтребуется\b", r"\bтребуются\b", r"\bвакансия\b", r"(?:срочно\s+)?нуж(?:ен|на|ны)\b", r"\bищу\b", r"\bищем\b",
    r"📌\s+\w", r"заказ\s*#\d+", r"связаться с заказчиком",
]
ORDER_FORMATS = [
    r"📌\s+\w", r"🔥\s*(?:заказ|срочн)", r"связаться с заказчиком", r"заказ\s*#\d+", r"freelancehunt\.com/project",
    r"freelance\.ua/orders", r"kwork\.ru/projects", r"finder\.work/vacancies", r"hh\.ru/vacancy",
]
REMOTE = [r"\bудаленно\b", r"удалённка", r"\bremote\b", r"из любой точк", r"работа на дом"]
TARGET_KEYWORDS = [
    "seo", "сео", "авито", "avito", "директ", "контекст", "маркетолог", "сайт", "тильда", "tilda",
]


@dataclass(frozen=True)
class ScorerLexicon:
    specialisations: Sequence[tuple[str, int, Sequence[str]]] = field(default_factory=lambda: ru.SPECIALISATIONS)
    spam: Sequence[str] = field(default_factory=lambda: ru.SPAM_PATTERNS)
    offer: Sequence[str] = field(default_factory=lambda: ru.OFFER_PATTERNS)
    offer_overrides: Sequence[str] = field(default_factory=lambda: OFFER_OVERRIDES)
    demand: Sequence[str] = field(default_factory=lambda: ru.DEMAND_PATTERNS)
    context: Sequence[str] = field(default_factory=lambda: ru.CONTEXT_PATTERNS)
    order_formats: Sequence[str] = field(default_factory=lambda: ORDER_FORMATS)
    excluded: Sequence[str] = field(default_factory=lambda: ru.EXCLUDED_SPECIALISATIONS)
    locations: Sequence[str] = field(default_factory=lambda: ru.EXCLUDED_LOCATIONS)
    platforms: Sequence[str] = field(default_factory=lambda: ru.EXCLUDED_PLATFORMS)
    agency: Sequence[str] = field(default_factory=lambda: ru.AGENCY_PATTERNS)
    team: Sequence[str] = field(default_factory=lambda: ru.TEAM_PATTERNS)
    exclusions: Sequence[str] = field(default_factory=lambda: ru.EXCLUSION_PATTERNS)
    remote: Sequence[str] = field(default_factory=lambda: REMOTE)
    targets: Sequence[str] = field(default_factory=lambda: TARGET_KEYWORDS)
    blocked_role: str = BLOCKED_ROLE
    agency_words: str = r"агентств|студи"
    positive: Sequence[str] = ()
    negative: Sequence[str] = ()


def _joined(patterns: Sequence[str]) -> str:
    pattern = "|".join(f"(?:{p})" for p in patterns)
    return _flags(pattern) + pattern


def _needed(pattern: str) -> tuple[str, ...]:
    return literals.needed(pattern) if _flags(pattern) != RE else ()


#: So many patterns are passed over at a time if none of them may match.
BLOCK = 8


def _with_found(text: Column, patterns: Sequence[str], body) -> Column:
    """``body(text, hit, may)``: ``hit(i)`` is whether pattern ``i`` matches, which is tried only on texts that hold a literal
    that it needs; ``may(places)`` is whether one of them has to be tried."""
    found = literals.possible(text, [_needed(p) for p in patterns])

    def looked(row):
        may = lambda places: literals.may(row["found"], places)
        return body(row["text"], lambda i: may([i]) & row["text"].rlike(_flags(patterns[i]) + patterns[i]), may)

    return T.let(F.struct(text.alias("text"), found.alias("found")), looked)


def _blocks(places: Sequence[int]) -> list[Sequence[int]]:
    return [places[i : i + BLOCK] for i in range(0, len(places), BLOCK)]


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern of the list matches a lower-cased text.  One pass finds the literals without which no pattern can
    match, and only patterns that may match are tried; those that need no literal are one alternation."""
    if not patterns:
        return F.lit(False)
    guarded = [p for p in patterns if _needed(p)]
    free = [p for p in patterns if not _needed(p)]
    result = F.lit(False)
    if guarded:
        either = lambda tests: reduce(lambda a, b: a | b, tests)
        every = range(len(guarded))
        result = _with_found(
            text, guarded, lambda s, hit, may: may(every) & either([may(block) & either(map(hit, block)) for block in _blocks(every)])
        )
    return F.coalesce(result | text.rlike(_joined(free)) if free else result, F.lit(False))


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Text matched by the first pattern of the list that matches, or null."""

    def first(s, hit, may):
        result = F.when(F.lit(False), F.lit(None).cast("string"))
        for i, p in enumerate(patterns):
            result = result.when(hit(i), F.regexp_extract(s, _flags(p) + p, 0))
        return F.when(may(range(len(patterns))), result)

    return _with_found(text, patterns, first) if patterns else F.lit(None).cast("string")


def _listed(patterns: Sequence[str], places: Sequence[int], hit, may) -> Column:
    """The patterns that match, of those at the places."""
    none = F.array().cast("array<string>")
    if not places:
        return none
    some = lambda block: F.array_compact(F.array(*[F.when(hit(i), F.lit(patterns[i])) for i in block]))
    parts = [F.when(may(block), some(block)).otherwise(none) for block in _blocks(places)]
    return F.when(may(places), F.concat(*parts)).otherwise(none)


def matched(text: Column, patterns: Sequence[str]) -> Column:
    every = range(len(patterns))
    return _with_found(text, patterns, lambda s, hit, may: _listed(patterns, every, hit, may)) if patterns else F.array().cast("array<string>")


def is_spam(low: Column, lex: ScorerLexicon) -> Column:
    return any_pattern(low, [*lex.spam, *lex.negative])


def is_offer(low: Column, lex: ScorerLexicon) -> Column:
    """An offer of services, unless the text clearly asks for some."""
    return any_pattern(low, lex.offer) & ~any_pattern(low, lex.offer_overrides)


def _candidate(order: int, name: str, rank: int):
    def candidate(hits):
        return F.struct(
            F.when(F.size(hits) > 0, rank).otherwise(0).alias("priority"),
            F.size(hits).alias("hits"),
            F.lit(-order).alias("order"),
            F.when(F.size(hits) > 0, name).alias("name"),
            hits.alias("matched"),
        )

    return candidate


def specialisation(low: Column, lex: ScorerLexicon) -> Column:
    """struct(priority, hits, name, matched) of the best class: priority, then hits, first class wins ties."""
    every = [p for _, _, patterns in lex.specialisations for p in patterns]

    def best(s, hit, may):
        candidates, first = [], 0
        for order, (name, rank, patterns) in enumerate(lex.specialisations):
            hits = _listed(every, range(first, first + len(patterns)), hit, may)
            candidates.append(T.let(hits, _candidate(order, name, rank)))
            first += len(patterns)
        return F.array_max(F.array(*candidates))

    return _with_found(low, every, best)


def demand(low: Column, lex: ScorerLexicon) -> Column:
    return F.when(any_pattern(low, lex.demand), 2).otherwise(0)


def context(low: Column, lex: ScorerLexicon) -> Column:
    return F.when(any_pattern(low, lex.context), 3).otherwise(0)


def order_format(low: Column, lex: ScorerLexicon) -> Column:
    return F.when(any_pattern(low, lex.order_formats), 2).otherwise(0)


def excluded_specialisation(low: Column, lex: ScorerLexicon) -> Column:
    return any_pattern(low, lex.excluded)


def exclusion_penalty(low: Column, lex: ScorerLexicon) -> Column:
    return F.size(matched(low, lex.exclusions)) * -3


def excluded_platforms(low: Column, lex: ScorerLexicon) -> Column:
    return matched(low, lex.platforms)


def agency(low: Column, lex: ScorerLexicon) -> Column:
    """struct(is_agency, needs_clarification)."""
    yes = any_pattern(low, lex.agency)
    unsure = ~yes & any_pattern(low, lex.team) & ~F.coalesce(low.rlike(RE + lex.agency_words), F.lit(False))
    return F.struct(yes.alias("is_agency"), unsure.alias("needs_clarification"))


def target_keyword(low: Column, lex: ScorerLexicon) -> Column:
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in lex.targets:
        result = result.when(low.rlike(rf"(?U)\b\Q{word.lower()}\E\b"), word)
    for pattern in lex.positive:
        result = result.when(low.rlike(_flags(pattern) + pattern), pattern)
    return result


def score_message(
    df, text: str, lex: ScorerLexicon | None = None, ts: str | None = None, now: Column | None = None,
    duplicate: Column | None = None,
):
    """Add is_lead, relevance_score, specialisation, keywords, rejection_reason and the score parts."""
    lex = lex or ScorerLexicon()
    raw, low = F.col(text), F.lower(F.col(text))
    df = df.withColumn("_low", low)
    low = F.col("_low")
    emoji = F.regexp_count(raw, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    early = (
        F.when(F.lit(False) if duplicate is None else duplicate, "Дубликат")
        .when(is_spam(low, lex), "Рекламный/промо контент")
        .when(emoji > 25, F.format_string("Избыток эмодзи (%d)", emoji))
        .when(is_offer(low, lex), "Предложение услуг (Sellers)")
    )
    df = T.computed_once(df, df.columns, [early.alias("_early")])
    going = F.col("_early").isNull()
    df = T.computed_once(df, df.columns, [F.when(going, specialisation(low, lex)).alias("_spec")])
    df = df.withColumn("_target", F.when(going & F.col("_spec.name").isNull(), target_keyword(low, lex)))
    by_keyword = F.col("_target").isNotNull()
    df = df.withColumn("_name", F.when(by_keyword, "Keyword Match").otherwise(F.col("_spec.name")))
    df = df.withColumn("_demand", F.when(going, F.struct(demand(low, lex).alias("d"), context(low, lex).alias("c"),
                                                         order_format(low, lex).alias("o"))))
    unknown = F.col("_name").isNull()
    role = F.regexp_extract(low, _flags(lex.blocked_role) + lex.blocked_role, 0)
    place = first_match(low, lex.locations)
    asks = F.greatest("_demand.d", "_demand.c", "_demand.o")
    reason = F.coalesce(
        F.col("_early"),
        F.when(unknown & (role != ""), F.concat(F.lit("Исключено: Блокируемая роль ("), role, F.lit(")"))),
        F.when(unknown & (asks == 0), "Нет demand-сигнала и не формат заказа"),
        F.when(unknown & excluded_specialisation(low, lex), "Исключенная специализация (SMM/Email/Analyst/CRM)"),
        F.concat(F.lit("Исключенная локация: "), place),
        F.when(unknown, "Специализация не определена"),
    )
    df = df.withColumn("rejection_reason", reason)
    open_ = F.col("rejection_reason").isNull()
    df = df.withColumn("budget", F.when(open_, numbers.money_strings(raw)))
    fresh = F.lit(0) if ts is None else F.coalesce(classify.freshness_bonus(F.col(ts), now), F.lit(0))
    parts = F.struct(
        F.col("_demand.d").alias("vacancy_indicators"),
        F.col("_demand.c").alias("context_indicators"),
        F.when(by_keyword, 3).otherwise(F.col("_spec.priority")).alias("specialization_match"),
        F.when(any_pattern(low, lex.remote), 1).otherwise(0).alias("remote_work"),
        F.when(F.col("budget").isNotNull(), 1).otherwise(0).alias("budget_mentioned"),
        fresh.alias("freshness"),
        exclusion_penalty(low, lex).alias("exclusions_penalty"),
        F.when(emoji > 15, -1).otherwise(0).alias("emoji_penalty"),
    )
    df = df.withColumn("score_parts", F.when(open_, parts))
    p = F.col("score_parts")
    total = (
        F.greatest(p["vacancy_indicators"], p["context_indicators"], F.col("_demand.o")) + p["specialization_match"]
        + p["remote_work"] + p["budget_mentioned"] + p["freshness"] + p["exclusions_penalty"] + p["emoji_penalty"]
    )
    df = df.withColumn("relevance_score", F.when(open_, total).otherwise(0))
    added = ["rejection_reason", "budget", "score_parts", "relevance_score"]
    kept = [c for c in df.columns if not c.startswith("_") and c not in added]
    keywords = F.when(by_keyword, F.array("_target")).otherwise(F.col("_spec.matched"))
    return T.computed_once(
        df,
        kept,
        [
            *map(F.col, added),
            (open_ & (F.col("relevance_score") >= 3)).alias("is_lead"),
            F.when(open_, F.col("_name")).alias("specialisation"),
            F.when(open_, keywords).otherwise(F.array().cast("array<string>")).alias("keywords"),
            (open_ & agency(low, lex)["needs_clarification"]).alias("needs_clarification"),
        ],
    )
