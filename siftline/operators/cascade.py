"""Rule cascade: hard blocks, weighted score, context, decision, priority, decision trail.

Every step is a built-in Column expression over the features of ``functions.text.features``.  Literals are
one array literal per group, patterns are literals too (compiled once), and the later steps are computed
only for rows the earlier ones left undecided.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import automaton, entities as E, literals
from siftline.functions import text as T
from siftline.lexicons.model import Lexicon

U = "(?U)"


def _unicode(pattern: str) -> str:
    """Unicode classes only where the pattern uses classes: they cost time on every character."""
    return U + pattern if re.search(r"\\[wWbBsSdD]", pattern) else pattern


def _literals(entries: Sequence[str]) -> Column:
    return F.array(*map(F.lit, entries)) if entries else F.array().cast("array<string>")


def _contained(entries: Sequence[str], *texts: Column) -> Column:
    """The listed literals found in any of the texts, in list order."""

    def found(entry):
        hit = F.contains(texts[0], entry)
        for other in texts[1:]:
            hit = hit | F.contains(other, entry)
        return hit

    return F.filter(_literals(entries), found)


def _first_pattern(prefix: str, patterns: Sequence[str], *texts: Column) -> Column:
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern in patterns:
        hit = texts[0].rlike(_unicode(pattern))
        for other in texts[1:]:
            hit = hit | other.rlike(_unicode(pattern))
        result = result.when(hit, F.lit(prefix + pattern))
    return result


#: Lists of more literals and patterns than this are looked for in one pass over a text, shorter ones one after the other.
FEW = 32


class _Seen:
    """What lists find in texts (by number): the entries held by any of the texts, or the first of them.  ``found`` has for each text
    the bits (``literals.possible``) of the entries in ``places``, so that only what may match is looked at; none without it."""

    def __init__(self, texts: Sequence[Column], found: Sequence[Column] | None = None, places: dict | None = None):
        self.texts, self.found, self.places = texts, found, places

    def contained(self, entries: Sequence[str], *texts: int) -> Column:
        """The listed literals found in any of the texts (by number), in list order."""
        if self.found is None or not entries:
            return _contained(entries, *[self.texts[i] for i in texts])
        places = [self.places["=", e] for e in entries]
        table = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(p // literals.WIDTH).alias("n"), F.lit(1 << p % literals.WIDTH).cast("long").alias("bit")) for e, p in zip(entries, places)])
        held = lambda e: reduce(or_, [F.get(self.found[i], e["n"]).bitwiseAND(e["bit"]) != 0 for i in texts])
        some = reduce(or_, [literals.may(self.found[i], places) for i in texts])
        return F.when(some, F.transform(F.filter(table, held), lambda e: e["entry"])).otherwise(F.array().cast("array<string>"))

    def first(self, prefix: str, entries: Sequence[str], *texts: int) -> Column:
        return F.concat(F.lit(prefix), F.get(self.contained(entries, *texts), 0))

    def first_pattern(self, prefix: str, patterns: Sequence[str], *texts: int) -> Column:
        if self.found is None or not patterns:
            return _first_pattern(prefix, patterns, *[self.texts[i] for i in texts])
        result = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern in patterns:
            place = [self.places["~", pattern]]
            hits = [literals.may(self.found[i], place) & self.texts[i].rlike(_unicode(pattern)) for i in texts]
            result = result.when(reduce(or_, hits), F.lit(prefix + pattern))
        places = [self.places["~", p] for p in patterns]
        return F.when(reduce(or_, [literals.may(self.found[i], places) for i in texts]), result)


#: Features that ``block_reason`` reads.
BLOCK_FEATURES = ("lowered", "folded", "refolded", "word_count", "emoji_density", "hashtags", "mentions")


def block_reason(lex: Lexicon) -> Column:
    """Reason of the first check that blocks the message, or null."""
    texts = [F.col(name) for name in ("lowered", "folded", "refolded")]
    listed = [*lex.domains, *lex.bots, *lex.scam_words, *lex.irrelevant, *lex.custom, *lex.repeated_spam]
    needs = {("=", e): (e,) for e in listed} | {("~", p): literals.needed(p) for p in lex.scam_patterns}
    if len(needs) <= FEW:
        return _block_reason(lex, _Seen(texts))
    places = {entry: place for place, entry in enumerate(needs)}
    found = [literals.possible(text, list(needs.values())) for text in texts]
    row = F.struct(*[c.alias(f"{kind}{i}") for kind, columns in (("text", texts), ("found", found)) for i, c in enumerate(columns)])
    number = range(len(texts))
    return T.let(row, lambda r: _block_reason(lex, _Seen([r[f"text{i}"] for i in number], [r[f"found{i}"] for i in number], places)))


def _unfolded(needs: Sequence[str]) -> bool:
    """Whether a folded text cannot hold any of the literals, because each has a letter that is folded."""
    return bool(needs) and all(set(need) & set(T.FOLD_FROM) for need in needs)


def _block_reason(lex: Lexicon, seen: _Seen) -> Column:
    raw, folded = 0, 1
    both = lambda entries: (raw,) if _unfolded(entries) else (raw, folded)
    patterns = (raw,) if lex.scam_patterns and all(_unfolded(literals.needed(p)) for p in lex.scam_patterns) else (raw, folded)
    names = F.col("mentions")
    robots = F.get(F.filter(names, lambda m: m.rlike("|".join(lex.bot_names) or "(?!)")), 0)
    return F.coalesce(
        seen.first("BLACKLIST_DOMAIN: ", lex.domains, raw),
        seen.first("BLACKLIST_BOT: ", lex.bots, raw),
        seen.first_pattern("SCAM_PATTERN: ", lex.scam_patterns, *patterns),
        seen.first("SCAM_KEYWORD: ", lex.scam_words, *both(lex.scam_words)),
        seen.first("IRRELEVANT_NICHE: ", lex.irrelevant, *both(lex.irrelevant)),
        seen.first("CUSTOM_PHRASE: ", lex.custom, *both(lex.custom)),
        F.when(
            F.col("emoji_density") > 0.3, F.format_string("EMOJI_SPAM: density=%.2f", F.col("emoji_density"))
        ),
        F.when(F.col("word_count") < 5, F.format_string("TOO_SHORT: %d words", F.col("word_count"))),
        F.when(
            F.size("hashtags") >= 4, F.format_string("HASHTAG_AGGREGATOR: %d hashtags", F.size("hashtags"))
        ),
        F.concat(F.lit("BOT_ACCOUNT: "), robots),
        _renormalised_block(lex, seen),
    )


def _renormalised_block(lex: Lexicon, seen: _Seen) -> Column:
    """Second pass for characters that only appear by lower-casing, such as an upper-case Ё."""
    again = 2
    spam = F.size(seen.contained(lex.repeated_spam, again))
    return F.when(
        F.col("refolded") != F.col("lowered"),
        F.coalesce(
            seen.first_pattern("UNICODE_SCAM_PATTERN: ", lex.scam_patterns, again),
            seen.first("UNICODE_SCAM_KEYWORD: ", lex.scam_words, again),
            seen.first("UNICODE_IRRELEVANT: ", lex.irrelevant, again),
            F.when(spam >= 2, F.format_string("UNICODE_SPAM: %d spam keywords after normalization", spam)),
        ),
    )


def _prefixed(found: Column, prefix: str) -> Column:
    return F.transform(found, lambda w: F.concat(F.lit(prefix), w))


def weighted_score(lex: Lexicon) -> Column:
    """struct(score, hits): weights of all cues found, and a readable list of them."""
    low, budget = F.col("lowered"), F.col("avg_budget")
    total, hits = F.lit(0), []
    for group in lex.groups:
        sign = f"{group.weight:+d}: {group.label}"
        if group.regex:
            for pattern in group.entries:
                n = F.regexp_count(low, F.lit(_unicode(pattern)))
                total = total + n * group.weight
                hits.append(F.when(n > 0, F.array(F.lit(sign + pattern))))
        else:
            found = _contained(group.entries, low)
            total = total + F.size(found) * group.weight
            hits.append(_prefixed(found, sign))
    total = total + F.when(budget > 5000, 1).when((budget > 0) & (budget < 1000), -2).otherwise(0)
    hits.append(F.when(budget > 5000, F.array(F.concat(F.lit("+1: BUDGET > 5000₽ ("), budget, F.lit(")")))))
    hits.append(
        F.when((budget > 0) & (budget < 1000), F.array(F.concat(F.lit("-2: LOW_BUDGET < 1000₽ ("), budget, F.lit(")"))))
    )
    empty = F.array().cast("array<string>")
    return F.struct(total.alias("score"), F.concat(*[F.coalesce(h, empty) for h in hits]).alias("hits"))


def context_adjust(lex: Lexicon, score: Column, source: Column, direction: Column) -> Column:
    """struct(final_score, hits): trust of the source and relevance of the topic."""
    trust = F.when(source.isin(*lex.sources_high), 1).when(source.isin(*lex.sources_low), -1).otherwise(0)
    topic = (
        F.when(direction.isin(*lex.topics_core), 2)
        .when(direction.isin(*lex.topics_secondary), 1)
        .when(direction.isin(*lex.topics_irrelevant), -2)
        .when(direction.isNull() | direction.isin("", "Unknown", "Keyword Match"), -3)
        .otherwise(0)
    )
    named = F.coalesce(direction, F.lit("None"))
    hits = F.array_compact(
        F.array(
            F.when(trust == 1, "+1: HIGH_TRUST_SOURCE").when(trust == -1, "-1: LOW_TRUST_SOURCE"),
            F.when(topic == 2, F.concat(F.lit("+2: CORE_NICHE ("), named, F.lit(")")))
            .when(topic == 1, F.concat(F.lit("+1: SECONDARY_NICHE ("), named, F.lit(")")))
            .when(topic == -2, F.concat(F.lit("-2: IRRELEVANT_NICHE ("), named, F.lit(")")))
            .when(topic == -3, F.concat(F.lit("-3: NO_DIRECTION ("), named, F.lit(")"))),
        )
    )
    return F.struct((score + trust + topic).alias("final_score"), hits.alias("hits"))


def direction_score(text: Column, lex: Lexicon, directions=None) -> Column:
    """Topic with the largest keyword weight (first topic wins ties), or ``Unknown``.

    A keyword weighs 1, 2.5 with a request cue within 80 characters of its first hit, -10 when negated.
    ``directions`` (topic -> keywords) replaces the lexicon's own vocabulary.
    """
    return T.let(F.lower(text), lambda low: _best_topic(low, lex, dict(directions or lex.directions)))


def with_direction(df: DataFrame, text: str, lex: Lexicon) -> DataFrame:
    """Add the direction to rows with features; most texts are as they are normalised, so their lower case is known."""
    low = F.when(F.col("norm") == F.col(text), F.col("lowered")).otherwise(F.lower(text))
    return df.withColumn("direction", T.let(low, lambda low: _best_topic(low, lex, dict(lex.directions))))


def direction_of(text: Column, lex: Lexicon, directions=None) -> Column:
    """``direction_score`` in one pass over the text: an automaton finds all keywords with their first places, so the cost does
    not grow with the vocabulary; weights are computed for the keywords found."""
    topics = dict(directions or lex.directions)
    entries = [(label, word) for label, words in enumerate(topics.values()) for word in words]
    longest = max((len(word) for _, word in entries), default=1)

    def best(row):
        hits, context = row["hits"], row["context"]
        weighed = F.transform(
            hits,
            lambda h: F.struct(
                h["label"].alias("label"),
                F.when(_negated(h["word"], context), -10.0).when(h["near"], 2.5).otherwise(1.0).alias("weight"),
            ),
        )

        def top(found):
            totals = [
                F.struct(F.aggregate(F.filter(found, lambda h: h["label"] == i), F.lit(0.0), lambda n, h: n + h["weight"]).alias("total"), F.lit(-i).alias("order"), F.lit(name).alias("topic"))
                for i, name in enumerate(topics)
            ]
            first = F.array_max(F.array(*totals)) if totals else F.struct(F.lit(0.0).alias("total"), F.lit("").alias("topic"))
            return F.when(first["total"] > 0, first["topic"]).otherwise(F.lit("Unknown"))

        return F.when(F.size(hits) > 0, T.let(weighed, top)).otherwise(F.lit("Unknown"))

    low = F.lower(text)
    found = F.coalesce(automaton.labelled_hits(entries, lex.request_cues)(low), F.array().cast("array<struct<label:int,word:string,at:int,near:boolean>>"))
    some = literals.possible(low, [literals.needed(p) for p in _negation_parts(lex)])
    negating = literals.may(some, range(len(lex.negations))) if lex.negations else F.lit(False)
    none = F.array().cast("array<string>")
    context = F.when(negating, _negation_context(low, lex, longest)).otherwise(F.struct(none.alias("follows"), none.alias("precedes")))
    return T.let(F.struct(found.alias("hits"), context.alias("context")), best)


BEFORE, AFTER = r"\s+{kw}", r"{kw}\s+"


def _negation_parts(lex: Lexicon) -> list[str]:
    """The negations without the keyword."""
    return [n.removesuffix(BEFORE) if n.endswith(BEFORE) else n.removeprefix(AFTER) for n in lex.negations]


def _negation_context(low: Column, lex: Lexicon, longest: int) -> Column:
    """struct(follows, precedes): what follows each negation, up to ``longest`` characters, and what precedes each one.

    Both patterns are fixed for the lexicon; no pattern is built from a keyword.
    """
    odd = [n for n in lex.negations if not (n.endswith(BEFORE) or n.startswith(AFTER))]
    if odd:
        raise ValueError(f"a negation has to start or end with the keyword: {odd}")
    before = "|".join(f"(?:{n.removesuffix(BEFORE)})" for n in lex.negations if n.endswith(BEFORE))
    after = "|".join(f"(?:{n.removeprefix(AFTER)})" for n in lex.negations if n.startswith(AFTER))
    none = F.array().cast("array<string>")
    follows = F.regexp_extract_all(low, F.lit(rf"(?U)(?s)(?=(?:{before})\s+(\S.{{0,{longest}}}))"), F.lit(1)) if before else none
    pieces = F.split(low, rf"(?U)\s+(?:{after})") if after else F.array(low)
    return F.struct(follows.alias("follows"), F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("precedes"))


def _best_topic(low: Column, lex: Lexicon, topics: dict) -> Column:
    cues = F.lit("(?:" + "|".join(f"\\Q{c}\\E" for c in lex.request_cues) + ")")
    longest = max((len(w) for words in topics.values() for w in words), default=1)

    def best(context):
        candidates = []
        for order, (topic, words) in enumerate(topics.items()):
            found = _contained(words, low)
            total = F.aggregate(found, F.lit(0.0), lambda acc, w: acc + _keyword_weight(low, w, cues, context))
            candidates.append(F.struct(total.alias("total"), F.lit(-order).alias("order"), F.lit(topic).alias("topic")))
        top = F.array_max(F.array(*candidates))
        return F.when(top["total"] > 0, top["topic"]).otherwise(F.lit("Unknown"))

    return T.let(_negation_context(low, lex, longest), best)


def _keyword_weight(low: Column, keyword: Column, cues: Column, context: Column) -> Column:
    return _weight(low, keyword, F.position(keyword, low), cues, context)


def _negated(keyword: Column, context: Column) -> Column:
    return F.exists(context["follows"], lambda s: F.startswith(s, keyword)) | F.exists(context["precedes"], lambda s: F.endswith(s, keyword))


def _weight(low: Column, keyword: Column, at: Column, cues: Column, context: Column) -> Column:
    start = F.greatest(at - 80, F.lit(1))
    window = F.substring(low, start, at + F.length(keyword) + 80 - start)
    return F.when(_negated(keyword, context), -10.0).when(F.regexp(window, cues), 2.5).otherwise(1.0)


def decide(df: DataFrame, lex: Lexicon, source: str, direction: str, hits: bool = True) -> DataFrame:
    """Decision of the rules: stage, is_lead (null while undecided), confidence, reason, final_score, hits (if wanted)."""
    src, topic = F.col(source), F.col(direction)
    df = df.withColumn("_block", block_reason(lex))
    df = df.withColumn("_scored", F.when(F.col("_block").isNull(), weighted_score(lex)))
    df = df.withColumn(
        "_context", F.when(F.col("_block").isNull(), context_adjust(lex, F.col("_scored.score"), src, topic))
    )
    banned = F.col("_block").isNull() & src.isin(*lex.sources_blocked)
    final = F.col("_context.final_score")
    accept, reject = final >= 3, final <= -2
    kept = [c for c in df.columns if not c.startswith("_")]
    listed = [F.concat(F.col("_scored.hits"), F.col("_context.hits")).alias("hits")] if hits else []
    return T.computed_once(df, kept, [
        F.when(F.col("_block").isNotNull(), "LEVEL_1_HARD_BLOCK")
        .when(banned, "LEVEL_3_CONTEXT_BLOCK")
        .when(accept | reject, "LEVEL_2_HEURISTIC")
        .alias("stage"),
        F.when(F.col("_block").isNotNull() | banned, False)
        .when(accept, True)
        .when(reject, False)
        .alias("is_lead"),
        F.when(F.col("_block").isNotNull() | banned, 0.99).when(accept | reject, 0.85).alias("confidence"),
        F.coalesce(
            F.col("_block"),
            F.when(banned, F.concat(F.lit("BLACKLIST_SOURCE: "), src)),
            F.when(accept, F.format_string("HEURISTIC_ACCEPT: score=%d", final)),
            F.when(reject, F.format_string("HEURISTIC_REJECT: score=%d", final)),
        ).alias("reason"),
        F.when(banned, -999).otherwise(final).alias("final_score"),
        *listed,
    ])


def cascade(
    df: DataFrame,
    lex: Lexicon,
    source: str = "source",
    direction: str = "direction",
    predict: Callable[[DataFrame], DataFrame] | None = None,
    hits: bool = True,
) -> DataFrame:
    """Full decision.  ``df`` carries the features.  Undecided rows go to ``predict`` (adds ``probability``);
    probabilities in (0.4, 0.6) are flagged for review, and so are all undecided rows without a model."""
    ruled = decide(df, lex, source, direction, hits)
    if predict is None:
        open_ = F.col("stage").isNull()
        return ruled.select(
            *[c for c in ruled.columns if c not in ("stage", "is_lead", "confidence", "reason")],
            F.coalesce("stage", F.lit("REVIEW")).alias("stage"),
            F.coalesce("is_lead", F.lit(False)).alias("is_lead"),
            F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
            F.coalesce("reason", F.format_string("UNCERTAIN: score=%d", F.col("final_score"))).alias("reason"),
            open_.alias("needs_review"),
        )
    decided = ruled.filter(F.col("stage").isNotNull()).withColumn("needs_review", F.lit(False))
    modelled = predict(ruled.filter(F.col("stage").isNull()).drop("stage", "is_lead", "confidence", "reason"))
    p = F.col("probability")
    modelled = (
        modelled.withColumn("stage", F.lit("LEVEL_MODEL"))
        .withColumn("is_lead", p > 0.5)
        .withColumn("confidence", p)
        .withColumn("reason", F.format_string("MODEL: p=%.2f", p))
        .withColumn("needs_review", (p > 0.4) & (p < 0.6))
        .drop("probability")
    )
    return decided.unionByName(modelled)


def priority(text: Column, source: Column, direction: Column, budget: Column, score: Column, lex: Lexicon) -> Column:
    """struct(priority, tier, factors) of an accepted message."""
    money = F.when(budget > 50000, 20).when(budget > 20000, 15).when(budget > 10000, 10).when(budget > 5000, 5).otherwise(0)
    bound = F.when(money == 20, "50k").when(money == 15, "20k").when(money == 10, "10k").otherwise("5k")
    urgent = T.let(F.lower(text), lambda low: F.size(_contained(lex.urgent, low))) > 0
    quality = T.let(F.lower(text), lambda low: F.size(_contained(lex.quality, low)))
    trust = F.when(source.isin(*lex.sources_high), 10).when(source.isin(*lex.sources_low), -10).otherwise(0)
    core = F.coalesce(direction.isin(*lex.topics_core), F.lit(False))
    strong = F.coalesce(score >= 5, F.lit(False))
    total = (
        50 + money + F.when(urgent, 10).otherwise(0) + quality * 5 + trust + F.when(core, 15).otherwise(0)
        + F.when(strong, 10).otherwise(0)
    )
    value = F.greatest(F.lit(0), F.least(F.lit(100), total))
    factors = F.array_compact(
        F.array(
            F.when(money > 0, F.concat(F.lit("+"), money, F.lit(": BUDGET > "), bound)),
            F.when(urgent, "+10: URGENT"),
            F.when(quality > 0, F.format_string("+%d: QUALITY_SIGNALS x%d", quality * 5, quality)),
            F.when(trust > 0, "+10: TRUSTED_SOURCE").when(trust < 0, "-10: LOW_TRUST_SOURCE"),
            F.when(core, "+15: CORE_EXPERTISE"),
            F.when(strong, "+10: HIGH_HEURISTIC_SCORE"),
        )
    )
    return F.struct(value.alias("priority"), tier_of(value).alias("tier"), factors.alias("factors"))


def tier_of(value: Column, hot: int = 70, warm: int = 50) -> Column:
    return F.when(value >= hot, "HOT").when(value >= warm, "WARM").otherwise("COLD")


def priority_boost(
    base: Column, budget_min: Column, urgency: Column, has_contact: Column, strict: bool = False
) -> Column:
    """Raise a priority struct by the extracted entities.  ``strict`` leaves the tier as it was."""
    rich = F.coalesce(budget_min > 50000, F.lit(False))
    pressing = F.coalesce(urgency.isin("urgent", "asap", "today"), F.lit(False))
    raised = (
        base["priority"]
        + F.when(rich, 15).otherwise(0)
        + F.when(pressing, 20).otherwise(0)
        + F.when(has_contact, 5).otherwise(0)
    )
    value = F.greatest(F.lit(0), F.least(F.lit(100), raised))
    more = F.array_compact(
        F.array(
            F.when(rich, "+15: NER_HIGH_BUDGET"),
            F.when(pressing, "+20: NER_URGENCY"),
            F.when(has_contact, "+5: NER_HAS_CONTACT"),
        )
    )
    tier = base["tier"] if strict else tier_of(value)
    return F.struct(value.alias("priority"), tier.alias("tier"), F.concat(base["factors"], more).alias("factors"))


OUTPUTS = ("tier", "priority", "factors", "trail")


def enrich(
    df: DataFrame, lex: Lexicon, source: str = "source", direction: str = "direction", text: str = "text", outputs=OUTPUTS
) -> DataFrame:
    """Priority, tier and factors for accepted rows; defaults for the others; the decision trail for all.

    Only the ``outputs`` named are computed: what is computed once per row cannot be pruned later.
    """
    base = priority(
        F.col(text), F.col(source), F.col(direction), F.col("avg_budget"), F.col("final_score"), lex
    )
    df = df.withColumn("_e", F.when(F.col("is_lead"), E.hybrid(F.col(text))))
    df = df.withColumn("_base", F.when(F.col("is_lead"), base))
    boosted = priority_boost(
        F.col("_base"), F.col("_e.budget_min"), F.col("_e.urgency"), F.coalesce("_e.has_contact", F.lit(False))
    )
    df = df.withColumn("_p", F.when(F.col("is_lead"), boosted))
    kept = [c for c in df.columns if not c.startswith("_")]
    made = {
        "tier": F.coalesce("_p.tier", default_tier(F.col("is_lead"))),
        "priority": F.coalesce("_p.priority", F.lit(0)),
        "factors": F.coalesce("_p.factors", F.array().cast("array<string>")),
        "trail": decision_trail(),
    }
    return T.computed_once(df, kept, [made[name].alias(name) for name in outputs])


def default_tier(is_lead: Column) -> Column:
    return F.when(is_lead, "WARM").otherwise("COLD")


def decision_trail() -> Column:
    blocked = F.col("stage") == "LEVEL_1_HARD_BLOCK"
    return F.array_compact(
        F.array(
            F.when(blocked, F.concat(F.lit("hard_blocked: "), F.col("reason"))).otherwise("hard_blocks_pass"),
            F.when(~blocked, F.format_string("heuristic_score: %d", F.col("final_score"))),
            F.when(~blocked, F.when(F.col("stage") == "LEVEL_MODEL", F.format_string("model: %.2f", F.col("confidence")))
                   .otherwise("model_skipped")),
            F.concat(F.lit("stage: "), F.col("stage")),
        )
    )


def report_priority(score: Column, contact_type: Column, contact_level: Column) -> Column:
    return (
        F.when((contact_type == "form") | ((score >= 6) & contact_level.isin("1A", "1B")), "HIGH")
        .when(score >= 4, "MEDIUM")
        .otherwise("LOW")
    )


def triage(df: DataFrame, lex: Lexicon, text: str = "text", source: str = "source", predict=None, outputs=OUTPUTS) -> DataFrame:
    """Features, topic, decision and priority of every message."""
    featured = with_direction(T.features(df, text), text, lex)
    decided = cascade(featured, lex, source, "direction", predict, hits=tuple(outputs) == OUTPUTS)
    return enrich(decided, lex, source, "direction", text, outputs)


def configured(values: DataFrame, key: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """Known settings as one typed row; a missing key takes its default (``wanted``: key -> default)."""
    return values.filter(F.col(key).isin(*wanted)).agg(
        *[F.coalesce(F.max(F.when(F.col(key) == k, F.col(value))), F.lit(v)).alias(k) for k, v in wanted.items()]
    )
