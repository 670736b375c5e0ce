import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.lexicons.builtin import RUSSIAN
from siftline.lexicons.model import from_rule_table, to_rule_table
from siftline.operators import cascade, scorer

SEO_REQUEST = "Нужен специалист по SEO для продвижения интернет-магазина. Бюджет 50000 руб. Срочно!"
HIGH_SOURCE = "Разработка и IT - Kwork фриланс заказы"


def decided(spark, rows, lexicon=RUSSIAN, predict=None):
    df = spark.createDataFrame(rows, "id LONG, text STRING, source STRING, direction STRING")
    return cascade.enrich(cascade.cascade(T.features(df), lexicon, predict=predict), lexicon)


def one(spark, text, source="any", direction="SEO", lexicon=RUSSIAN):
    return decided(spark, [(1, text, source, direction)], lexicon).first()


def test_worked_example(spark):
    got = one(spark, SEO_REQUEST, HIGH_SOURCE)
    assert (got["is_lead"], got["confidence"], got["final_score"]) == (True, 0.85, 8)
    assert got["reason"] == "HEURISTIC_ACCEPT: score=8"
    assert (got["priority"], got["tier"]) == (100, "HOT")
    assert "+15: BUDGET > 20k" in got["factors"] and "+15: CORE_EXPERTISE" in got["factors"]
    assert got["trail"] == ["hard_blocks_pass", "heuristic_score: 8", "model_skipped", "stage: LEVEL_2_HEURISTIC"]


def test_seller_is_rejected(spark):
    got = one(spark, "Привет! Я таргетолог, настрою вам рекламу. Пишите в ЛС.", "ФРИЛАНС | ВАКАНСИИ INSTAGRAM",
              "таргетированная реклама")
    assert not got["is_lead"] and got["tier"] == "COLD" and got["priority"] == 0


def test_short_request_is_a_lead(spark):
    assert one(spark, "Нужен спец по авито, бюджет 5к", "Таргет | Арбитраж | Вакансии", "авито")["is_lead"]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("заказы на kwork.ru каждый день новые", "BLACKLIST_DOMAIN: kwork.ru"),
        ("лучшие чаты тут @getclient_tg_bot заходи скорее", "BLACKLIST_BOT: @getclient_tg_bot"),
        ("легкий заработок для всех желающих дома", "SCAM_PATTERN: легкий заработок"),
        ("нужны воркеры в команду быстро сегодня", "SCAM_KEYWORD: воркер"),
        ("Нужна бухгалтерия для фирмы срочно и недорого", "IRRELEVANT_NICHE: бухгалтерия"),
        ("нужен сайт", "TOO_SHORT: 2 words"),
        ("нужен хороший сайт для меня #один #два #три #четыре", "HASHTAG_AGGREGATOR: 4 hashtags"),
        ("нужен сайт для магазина пишите @vacancy_hot_bot", "BOT_ACCOUNT: @vacancy_hot_bot"),
        ("один 😀 два 😀 три 😀 четыре 😀 пять", "EMOJI_SPAM: density=0.80"),
    ],
)
def test_hard_blocks(spark, text, reason):
    got = one(spark, text)
    assert (got["reason"], got["stage"], got["confidence"]) == (reason, "LEVEL_1_HARD_BLOCK", 0.99)


def test_latin_letters_do_not_hide_a_blocked_word(spark):
    assert one(spark, "кардинг не пройдёт тут никогда больше".replace("а", "a"))["reason"] == "SCAM_KEYWORD: кардинг"


def test_custom_phrase(spark):
    lexicon = replace(RUSSIAN, custom=["особая фраза"])
    assert one(spark, "это особая фраза про новый сайт компании", lexicon=lexicon)["reason"] == "CUSTOM_PHRASE: особая фраза"


def test_upper_case_yo_reaches_the_second_pass(spark):
    lexicon = replace(RUSSIAN, irrelevant=["елки продаем"])
    assert one(spark, "Ёлки продаем большие и маленькие всем", lexicon=lexicon)["reason"] == "UNICODE_IRRELEVANT: елки продаем"


def test_blocked_source(spark):
    got = one(spark, SEO_REQUEST, "VK Freelance All")
    assert (got["stage"], got["final_score"]) == ("LEVEL_3_CONTEXT_BLOCK", -999)


def test_undecided_rows_go_to_the_model_only(spark):
    rows = [(1, SEO_REQUEST, HIGH_SOURCE, "SEO"), (2, "просто длинное сообщение обо всём на свете", "any", "другое")]
    seen = []

    def predict(df):
        seen.append(df)
        return df.withColumn("probability", F.lit(0.55))

    got = {r["id"]: r for r in decided(spark, rows, predict=predict).collect()}
    assert [r["id"] for r in seen[0].collect()] == [2]
    assert got[2]["stage"] == "LEVEL_MODEL" and got[2]["is_lead"] and got[2]["needs_review"]
    assert got[1]["stage"] == "LEVEL_2_HEURISTIC" and not got[1]["needs_review"]


def test_score_is_additive_and_counts_matches(spark):
    df = spark.createDataFrame([("нужен нужен бюджет подскажите мои кейсы",)], "text STRING")
    got = T.features(df).select(cascade.weighted_score(RUSSIAN).alias("s")).first()["s"]
    assert got["score"] == 3 * 2 + 1 + 2 - 3
    assert got["hits"] == [r"+3: \bнужен\b", "+2: подскажите", "+1: бюджет", "-3: мои кейсы"]


@pytest.mark.parametrize(
    "text, topic",
    [
        ("Ищем специалиста: авито под ключ", "авито"),
        ("нам не нужен директ", "Unknown"),
        ("у нас есть авито, а нужен сайт", "разработка сайтов"),
        ("просто привет", "Unknown"),
        ("сео и контекст", "SEO"),
    ],
)
def test_direction(spark, text, topic):
    assert spark.range(1).select(cascade.direction_score(F.lit(text), RUSSIAN).alias("d")).first()["d"] == topic


def brute_topic(text):
    """The rule in plain Python: keywords add 1, 2.5 near a request, -10 if negated; the first best topic with a positive sum."""
    low, sums = text.lower(), {}
    for topic, words in RUSSIAN.directions.items():
        total = 0.0
        for w in words:
            if w in low:
                at = low.find(w)
                near = low[max(0, at - 80) : at + len(w) + 80]
                negated = any(re.search(n.replace("{kw}", re.escape(w)), low) for n in RUSSIAN.negations)
                total += -10 if negated else 2.5 if any(c in near for c in RUSSIAN.request_cues) else 1
        if total > 0:
            sums[topic] = total
    return max(sums, key=sums.get) if sums else "Unknown"


def test_every_keyword_gives_its_topic(spark):
    """All keywords, plain, requested, negated before and after, and two at a time."""
    words = [w for topic in RUSSIAN.directions.values() for w in topic]
    assert len(words) == 792
    forms = ["{a}", "Ищем: {a}, срочно", "не нужен {a}", "{a} не требуется", "у нас есть {a}, нужен {b}", "без  {b} и {a}", "сам веду {a} свой {b}"]
    texts = [form.format(a=w, b=words[(7 * i + 3) % len(words)]) for i, w in enumerate(words) for form in forms]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(8)
    got = {r["text"]: r["d"] for r in df.select("text", cascade.direction_score(F.col("text"), RUSSIAN).alias("d")).collect()}
    assert got == {t: brute_topic(t) for t in texts}


def test_direction_vocabulary_is_a_parameter(spark):
    got = cascade.direction_score(F.lit("нужен ландшафт"), RUSSIAN, {"сад": ["ландшафт"]})
    assert spark.range(1).select(got.alias("d")).first()["d"] == "сад"


def test_rule_table_round_trip(spark):
    table = to_rule_table(spark, RUSSIAN)
    assert table.filter("stage = 'score'").count() == 131
    back = from_rule_table(table, RUSSIAN)
    assert list(back.irrelevant) == list(RUSSIAN.irrelevant)
    assert [(g.name, g.weight, list(g.entries)) for g in back.groups] == [
        (g.name, g.weight, list(g.entries)) for g in RUSSIAN.groups
    ]
    fewer = from_rule_table(table.withColumn("enabled", F.col("pattern") != "бюджет"), RUSSIAN)
    assert "бюджет" not in [e for g in fewer.groups for e in g.entries]


def test_priority_stays_in_range(spark):
    for text, source in [(SEO_REQUEST + " тз бриф zoom созвон встреча детали", HIGH_SOURCE), ("нужен сайт " * 3, "ЖВБ – Фриланс и отзывы за деньги")]:
        assert 0 <= one(spark, text, source)["priority"] <= 100


def scored(spark, text, **extra):
    return scorer.score_message(spark.createDataFrame([(text,)], "text STRING"), "text", **extra).first()


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Приглашаем на вебинар", "Рекламный/промо контент"),
        ("Предлагаю услуги по настройке", "Предложение услуг (Sellers)"),
        ("Нужен администратор в чат", "Исключено: Блокируемая роль (администратор)"),
        ("Всем хорошего дня", "Нет demand-сигнала и не формат заказа"),
        ("Нужен аналитик", "Исключенная специализация (SMM/Email/Analyst/CRM)"),
        ("Нужен seo специалист, Ташкент", "Исключенная локация: ташкент"),
        ("Нужен водитель", "Специализация не определена"),
        ("😀" * 26 + " нужен seo", "Избыток эмодзи (26)"),
    ],
)
def test_scorer_rejections(spark, text, reason):
    got = scored(spark, text)
    assert got["rejection_reason"] == reason and not got["is_lead"] and got["relevance_score"] == 0


def test_scorer_accepts(spark):
    got = scored(spark, "Нужен seo специалист, удаленно, бюджет: 50 тыс")
    assert got["is_lead"] and got["specialisation"] == "SEO"
    parts = got["score_parts"]
    assert (parts["vacancy_indicators"], parts["context_indicators"], parts["specialization_match"]) == (2, 3, 3)
    assert got["relevance_score"] == 3 + 3 + 1 + 1


def test_scorer_keyword_match(spark):
    got = scored(spark, "Нужен директолог-стажер? нет: нужен контекст")
    assert got["specialisation"] in ("контекстная реклама", "Keyword Match")


def test_scorer_duplicate_comes_first(spark):
    assert scored(spark, "Нужен seo", duplicate=F.lit(True))["rejection_reason"] == "Дубликат"


def test_agency(spark):
    lex = scorer.ScorerLexicon()
    row = spark.range(1).select(
        scorer.agency(F.lit("ищем в команду маркетолога"), lex).alias("a"),
        scorer.agency(F.lit("расширяем команду мастеров"), lex).alias("b"),
        scorer.agency(F.lit("требуется в команду мастер"), lex).alias("c"),
    ).first()
    assert row["a"]["is_agency"] and row["b"]["is_agency"]
    assert row["c"]["needs_clarification"] and not row["c"]["is_agency"]


def test_long_lists_in_one_pass_give_the_same_reasons(spark, monkeypatch):
    """Every entry of the Russian lists, in plain, folded and re-normalised spellings: bits of an automaton against plain search."""
    entries = [*RUSSIAN.domains, *RUSSIAN.bots, *RUSSIAN.scam_words, *RUSSIAN.irrelevant, *RUSSIAN.repeated_spam]
    frames = ["Сегодня у нас {} и ещё что-то для всех", "сегодня ЁЛКА {} и {} для всех нас", "{}"]
    made = [frame.format(e, entries[i - 1]) for i, e in enumerate(entries) for frame in frames]
    made += [e.replace("о", "o").replace("е", "Ё") + " для всех нас тут" for e in entries]
    df = spark.createDataFrame([(t,) for t in [*made, "", None, "просто текст о погоде и природе"]], "text STRING")
    rows = {}
    for few in (0, 10**6):
        monkeypatch.setattr(cascade, "FEW", few)
        rows[few] = [tuple(r) for r in T.features(df, "text").select("text", cascade.block_reason(RUSSIAN).alias("r")).collect()]
    assert sorted(rows[0], key=str) == sorted(rows[10**6], key=str)
    assert len({r for _, r in rows[0]}) > 50


def test_a_text_is_normalised_once_for_all_features(spark):
    df = spark.createDataFrame([("текст",)], "text STRING")
    plan = T.features(df, "text").select(cascade.block_reason(RUSSIAN).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_customers_are_dealt_out(spark):
    from siftline.plans import text_functions

    class Source:
        customer = spark.range(100, numPartitions=1).selectExpr("id AS c_custkey", "'x' AS c_name", "'MACHINERY' AS c_mktsegment")

    made = text_functions.message_contacts(Source)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["contact"]["priority_level"] for r in made.collect()} == {"1C"}
