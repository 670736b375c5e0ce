import re
import unicodedata

from pyspark.sql import functions as F

from siftline.functions import classify, entities, similarity, text as T


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_normalize_composes_and_folds(spark):
    decomposed = unicodedata.normalize("NFD", "ёлка й")
    assert value(spark, T.normalize_unicode(F.lit(decomposed))) == "елка й"
    assert value(spark, T.normalize_unicode(F.lit("ᴘʀΙвет"))) == "рʀΙвет"
    assert value(spark, T.normalize_unicode(F.lit(None).cast("string"))) is None


def test_compose_is_nfc(spark):
    texts = ["abc", "é", "Å", "각", "Ω", "й", " x", "ﬁ", "क़", "日本", "😀ë"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", T.compose(F.col("t")).alias("c")).collect():
        assert row["c"] == unicodedata.normalize("NFC", row["t"])


def test_fold(spark):
    assert value(spark, T.fold_homoglyphs(F.lit("pоcт"))) == "рост"


def test_counts_follow_python(spark):
    texts = ["Привет, мир! #Тег @User", "  --  ", "a_b c-d é1", "один два\tтри", "x . y", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    rows = df.select("t", T.word_count(F.lower("t")).alias("n"), T.words(F.lower("t")).alias("w")).collect()
    for row in rows:
        expected = re.sub(r"[^\w\s]", "", row["t"].lower()).split()
        assert (row["n"], row["w"]) == (len(expected), expected)


def test_budget_of_grouped_digits_is_zero(spark):
    assert value(spark, T.budget_values(F.lit("50 000 руб и 30 usd"))) == [0, 30]


def test_emoji_runs(spark):
    assert value(spark, T.emoji_runs(F.lit("😀😀 a 🚀 日"))) == 3


def test_hash_ignores_case_and_space(spark):
    assert value(spark, T.text_hash(F.lit("А б\nВ"))) == value(spark, T.text_hash(F.lit("абв")))


def test_keywords(spark):
    assert value(spark, T.keywords(F.lit("Реклама для сайта и на авито, да"))) == ["реклама", "сайта", "авито"]


def test_contacts(spark):
    text = "Пишите a.b@mail.ru или +7 (912) 345-67-89, @handle_1 и @abc http://t.me/x"
    got = value(spark, entities.contact_spans(F.lit(text)))
    assert got["emails"] == ["a.b@mail.ru"] and got["phones"] == ["+7 (912) 345-67-89"]
    assert got["handles"] == ["handle_1"] and got["urls"] == ["http://t.me/x"] and got["has_contact"]
    assert "@mail.ru" not in value(spark, entities.mask_contacts(F.lit(text)))


FWD = "struct<from_id:bigint,from_username:string,channel_id:bigint>"


def contact(spark, text="", buttons=None, name=None, sender=None, fwd=None):
    f = F.lit(None).cast(FWD) if fwd is None else F.struct(*[F.lit(v).alias(n) for n, v in zip(["from_id", "from_username", "channel_id"], fwd)]).cast(FWD)
    return value(
        spark,
        entities.contact_priority(
            F.lit(text), F.lit(buttons).cast("string"), F.lit(name).cast("string"), F.lit(sender).cast("bigint"), f
        ),
    )


def test_contact_levels(spark):
    assert contact(spark, fwd=(5, "ann", None))["contact_value"] == "@ann"
    assert contact(spark, fwd=(5, None, None))["contact_link"] == "tg://user?id=5"
    assert contact(spark, fwd=(5, "ann", 9), sender=1)["priority_level"] == "3"
    buttons = "🔘 КНОПКИ:\n• Сайт → https://x.y\n• Связаться → https://t.me/boss\n• Канал → https://t.me/chan"
    best = contact(spark, buttons=buttons)
    assert (best["priority_level"], best["contact_value"]) == ("1A", "@boss")
    assert best["backup_contacts"] == ["https://x.y", "https://t.me/chan"]
    named = contact(spark, text="Пишите в личку @Ann с пометкой #seo")
    assert (named["priority_level"], named["contact_value"], named["additional_instructions"]) == ("1B", "@Ann", "с пометкой #seo")
    assert contact(spark, text="подробности в личные сообщения")["priority_level"] == "1C"
    phone = contact(spark, text="звоните 8 912 345-67-89 Анна")
    assert (phone["priority_level"], phone["contact_value"]) == ("1D", "8 912 345-67-89 (Анна)")
    assert phone["contact_link"] == "tel:89123456789"
    assert contact(spark, text="привет", name="bob")["contact_value"] == "@bob"
    other = contact(spark, text="см. @one @two")
    assert (other["priority_level"], other["backup_contacts"]) == ("4", ["@two"])
    assert contact(spark, text="анкета https://forms.gle/abc")["contact_type"] == "form"
    last = contact(spark, text="Всем привет \n Нужен спец по сбору данных. Есть такие?", sender=123456789)
    assert (last["priority_level"], last["contact_link"], last["extraction_confidence"]) == ("3", "tg://user?id=123456789", "medium")
    assert contact(spark, text="привет")["priority_level"] == "none"


def test_niche(spark):
    named = value(spark, entities.niche(F.lit("Сайт для клиника врач и кафе")))
    assert (named["name"], named["confidence"]) == ("медицина", "high")
    free = value(spark, entities.niche(F.lit("в нише вязание крючком")))
    assert (free["name"], free["confidence"]) == ("вязание крючком", "medium")
    near = value(spark, entities.niche(F.lit("нужен риэлтор")))
    assert (near["name"], near["pattern"]) == ("недвижимость", "context_matching")
    assert value(spark, entities.niche(F.lit("привет")))["confidence"] == "none"


def test_companies(spark):
    got = value(spark, entities.company_names(F.lit("компания «Ромашка» и для Новый Дом, компания «Ромашка»")))
    assert got == ["Ромашка", "Новый Дом"]


def test_hybrid(spark):
    got = value(spark, entities.hybrid(F.lit("бюджет 70 тыс, срочно, a@b.ru")))
    assert (got["budget_min"], got["urgency"], got["has_contact"], got["method"]) == (70000, "urgent", True, "named_amount")
    strict = value(spark, entities.hybrid(F.lit("бюджет 70 тыс, срочно, a@b.ru"), strict=True))
    assert (strict["urgency"], strict["has_contact"]) == (None, False)


def test_classify(spark):
    got = value(spark, classify.classify(F.lit("Сколько стоит сайт на tilda? Срочно, бюджет 300 usd")))
    assert (got["intent"], got["category"], got["tone"]) == ("pricing_inquiry", "разработка сайтов", "neutral_hurry")
    assert got["score"] == 7.0 and got["entities"]["budget"] == 300


def test_leaks_and_replies(spark):
    assert value(spark, classify.leak_check(F.lit("Traceback (most recent call last)")))["verdict"] == "BLOCK"
    assert value(spark, classify.leak_check(F.lit("Добрый день")))["verdict"] == "ALLOW"
    assert value(spark, classify.bot_autoreply(F.lit("Неизвестная команда")))
    assert not value(spark, classify.bot_autoreply(F.lit("советуем")))
    assert value(spark, classify.bot_autoreply(F.lit("ID: ab12/34cd56")))


def test_tags(spark):
    got = value(spark, classify.tag_extract(F.lit("Да. [ASK_ADMIN: сколько?]"), "ASK_ADMIN", "?"))
    assert (got["content"], got["text"]) == ("сколько?", "Да.")


def test_json_salvage(spark):
    cases = {
        '[{"id": 1, "result": "BUYER", "reason": "a", "marker": "m"}]': [(1, "BUYER", "a")],
        'Вот:\n```json\n[{"id": 2, "result": "SELLER", "reason": "b"},]\n```': [(2, "SELLER", "b")],
        "[{id: 3, result: buyer, reason: c}]": [(3, "BUYER", "c")],
        '[{"id": 4, "result": "BUYER", "reason": "d"}, {"id": 5, "result": "SEL': [(4, "BUYER", "d"), (5, "SEL", "")],
    }
    for raw, expected in cases.items():
        got = value(spark, classify.json_salvage(F.lit(raw)))
        assert [(o["id"], o["result"], o["reason"] or "") for o in got] == expected


def test_output_clean(spark):
    assert value(spark, classify.output_clean(F.lit(' «Да» ')))["text"] == "Да"
    assert value(spark, classify.output_clean(F.lit('{"a": 1}')))["text"] == '{"a": 1}'
    assert value(spark, classify.output_clean(F.lit("Rate limit reached")))["is_failure"]


def test_jaccard_is_symmetric(spark):
    a, b = similarity.shingles(F.lit("привет мир")), similarity.shingles(F.lit("привет мама"))
    assert value(spark, similarity.jaccard(a, b)) == value(spark, similarity.jaccard(b, a)) > 0
    assert value(spark, similarity.jaccard(a, similarity.shingles(F.lit("x")))) == 0.0
