"""Numbers, money ranges and dates written in Russian text, as Column expressions.

``strict=True`` reproduces the literal behaviour of the original parser where it departs from its own
documentation; the default is the documented value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import extract_all

# Numerals.
NUMBER_WORDS = {
    "один": 1, "одна": 1, "одно": 1,
    "два": 2, "две": 2,
    "три": 3, "четыре": 4, "пять": 5,
    "шесть": 6, "семь": 7, "восемь": 8, "девять": 9,
    "десять": 10, "одиннадцать": 11, "двенадцать": 12,
    "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15,
    "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18,
    "девятнадцать": 19, "двадцать": 20, "тридцать": 30,
    "сорок": 40, "пятьдесят": 50, "шестьдесят": 60,
    "семьдесят": 70, "восемьдесят": 80, "девяносто": 90,
    "сто": 100, "двести": 200, "триста": 300,
    "четыреста": 400, "пятьсот": 500, "шестьсот": 600,
    "семьсот": 700, "восемьсот": 800, "девятьсот": 900,
    "тысяч": 1000, "тысяча": 1000, "тысячи": 1000,
    "миллион": 1000000, "миллиона": 1000000, "миллионов": 1000000,
    "тыс": 1000, "тыщ": 1000, "к": 1000,
    "млн": 1000000, "мил": 1000000,
}

# Relative periods in days, urgent words and entity urgency classes in order of precedence.
PERIODS = {
    "сегодня": 0, "завтра": 1, "послезавтра": 2, "через день": 2, "через неделю": 7, "через две недели": 14,
    "через месяц": 30,
}
URGENT = ["срочно", "асап", "asap", "немедленно"]
MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
URGENCY = [
    (r"\bсрочно\b", "urgent"),
    (r"\bасап\b|asap", "asap"),
    (r"\bсегодня\b", "today"),
    (r"\bзавтра\b", "tomorrow"),
    (r"\bна этой неделе\b", "this_week"),
    (rf"\bдо\s+(\d{{1,2}})\s+({MONTHS})", "specific_date"),
]

# Money strings of the second scorer.
MONEY_STRINGS = [
    r"(?:от|до|–|-|—|\s)(\d{1,3}(?:\s?\d{3})?)\s?(?:₽|руб|р\.|т\.р\.|тыс|k|к|usd|\$|euro|€)(?!\w)",
    r"(?:оплата|бюджет|зп|доход|ставка):?\s?(\d{1,3}(?:\s?\d{3})?)\s?(?:₽|руб|р\.|т\.р\.|тыс|k|к|usd|\$|euro|€)?(?!\w)",
    r"(\d{1,3}(?:\s?\d{3})?)\s?-\s?(\d{1,3}(?:\s?\d{3})?)\s?(?:₽|руб|р\.|т\.р\.|тыс|k|к|usd|\$|euro|€|net|gross)?(?!\w)",
]

U = "(?iU)"
THOUSAND = "тысяч[аи]?|тыс|тыщ|к"
MILLION = "миллион(?:а|ов)?|млн|мил|м"


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, ",", ".").try_cast("double")


def _scaled(number: Column, unit: Column, thousand: list[str], million: list[str]) -> Column:
    return F.when(unit.isin(*thousand), number * 1000).when(unit.isin(*million), number * 1000000)


def _fold_words(text: Column, strict: bool) -> Column:
    """Numerals left to right: small ones add up, a multiplier applies to what has been added."""
    values = dict(NUMBER_WORDS) if strict else {**NUMBER_WORDS, "половиной": 0.5}
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    known = F.filter(
        F.transform(extract_all(text, "[а-яё]+"), lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull()
    )
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("current"))

    def step(acc, value):
        current = F.when(acc["current"] == 0, F.lit(1.0)).otherwise(acc["current"])
        return F.when(
            value >= 1000, F.struct((acc["total"] + current * value).alias("total"), F.lit(0.0).alias("current"))
        ).otherwise(F.struct(acc["total"].alias("total"), (acc["current"] + value).alias("current")))

    total = F.aggregate(known, start, step, lambda acc: acc["total"] + acc["current"])
    return F.when(total > 0, total)


def text_to_number(text: Column, strict: bool = False) -> Column:
    low = F.trim(F.lower(text))
    if strict:
        pattern = r"(\d+(?:[.,]\d+)?)\s*([кмтмил]+)"
        suffixed = _scaled(
            _number(F.regexp_extract(low, pattern, 1)),
            F.regexp_extract(low, pattern, 2),
            ["к", "тыс", "тысяч"],
            ["м", "млн", "мил"],
        )
    else:
        number = r"(\d+(?:[.,]\d+)?)\s*"
        suffixed = F.coalesce(
            _number(_first(low, number + f"(?:{THOUSAND})(?![а-яё])", 1)) * 1000,
            _number(_first(low, number + f"(?:{MILLION})(?![а-яё])", 1)) * 1000000,
        )
    digits = _first(low if strict else F.regexp_replace(low, r"(\d)\s+(?=\d{3}(?!\d))", "$1"), r"\d+").try_cast("double")
    return F.coalesce(suffixed, _fold_words(low, strict), digits).cast("long")


def _unit(text: Column) -> Column:
    return F.when(text.rlike(rf"(?iU)(?:{MILLION})\s*$"), 1000000).when(text.rlike(rf"(?iU)(?:{THOUSAND})\s*$"), 1000)


def budget_range(text: Column, strict: bool = False) -> Column:
    """struct(min, max): the first of from-to, up to, from, about, number with currency."""
    if strict:
        body, end = r"([а-яё\d\s.,]+?)", r"(?:\s|$|[₽руб])"
        span = rf"{U}от\s+{body}\s+до\s+{body}{end}"
        simple = rf"{U}(\d+(?:\s*\d+)*)\s*(?:₽|руб|рублей|тысяч|тыс|к)"
    else:
        words = "|".join(w for w in NUMBER_WORDS if len(w) > 2) + "|половиной|с"
        body = (
            rf"(\d[\d.,]*(?:\s\d{{3}})*(?:\s*(?:{THOUSAND}|{MILLION})(?![а-яё]))?"
            rf"|(?:(?:{words})(?![а-яё])\s*)+)"
        )
        end = ""
        span = rf"{U}от\s+{body}\s*до\s+{body}"
        simple = rf"{U}\d[\d.,]*(?:\s\d{{3}})*\s*(?:(?:{THOUSAND}|{MILLION})(?![а-яё])|(?=₽|руб))"
    most = rf"{U}(?:до|максимум|не более)\s+{body}{end}"
    least = rf"{U}от\s+{body}{end}"
    about = rf"{U}(?:примерно|около|приблизительно|~)\s{'+' if strict else '*'}{body}{end}"

    def number(pattern, group):
        return text_to_number(F.regexp_extract(text, pattern, group), strict)

    low, high = number(span, 1), number(span, 2)
    if not strict:
        unit = _unit(F.regexp_extract(text, span, 2))
        own = _unit(F.regexp_extract(text, span, 1))
        low = F.when(own.isNull() & unit.isNotNull() & (low < 1000), low * unit).otherwise(low)
    none = F.lit(None).cast("long")
    single = text_to_number(F.regexp_extract(text, simple, 0), strict)

    def pair(a, b):
        return F.struct(a.cast("long").alias("min"), b.cast("long").alias("max"))

    return (
        F.when(text.rlike(span), pair(low, high))
        .when(text.rlike(most), pair(none, number(most, 1)))
        .when(text.rlike(least), pair(number(least, 1), none))
        .when(text.rlike(about), pair(number(about, 1), number(about, 1)))
        .when(text.rlike(simple), pair(single, single))
        .otherwise(pair(none, none))
    )


def _plus_days(anchor: Column, days: Column) -> Column:
    return anchor + F.make_dt_interval(days.cast("int"))


def deadline(text: Column, anchor: Column, strict: bool = False) -> Column:
    """Deadline relative to ``anchor`` (the time of the message)."""
    low = F.lower(text)
    anchor = anchor.cast("timestamp")
    day = F.to_date(anchor)
    clock = anchor - F.date_trunc("day", anchor)
    periods = list(PERIODS.items()) if strict else sorted(PERIODS.items(), key=lambda p: -len(p[0]))
    result = F.when(F.coalesce(*[F.when(F.contains(low, F.lit(w)), True) for w in URGENT], F.lit(False)), anchor)
    for phrase, days in periods:
        result = result.when(F.contains(low, F.lit(phrase)), _plus_days(anchor, F.lit(days)))
    to_sunday = F.pmod(6 - F.weekday(anchor), F.lit(7))
    to_sunday = F.when(to_sunday == 0, 7).otherwise(to_sunday)
    result = result.when(low.rlike("кон(?:ец|ца) недели"), _plus_days(anchor, to_sunday))
    result = result.when(
        low.rlike("кон(?:ец|ца) месяца"), F.last_day(day).cast("timestamp") + clock
    )
    number = _first(low, r"до\s+(\d{1,9})\s*(?:числа|го)?", 1).try_cast("int")
    later = F.add_months(F.trunc(day, "month"), 1)
    month = F.when(number < F.dayofmonth(day), later).otherwise(F.trunc(day, "month"))
    fits = (number >= 1) & (number <= F.dayofmonth(F.last_day(day))) & (number <= F.dayofmonth(F.last_day(month)))
    result = result.when(F.coalesce(fits, F.lit(False)), F.date_add(month, number - 1).cast("timestamp") + clock)
    period = r"через\s+(\d+|[а-яё]+)\s+(день|дня|дней|неделю|недели|недель|месяц|месяца|месяцев)"
    count = F.coalesce(text_to_number(F.regexp_extract(low, period, 1), strict), F.lit(1))
    unit = F.regexp_extract(low, period, 2)
    scale = F.when(unit.startswith("д"), 1).when(unit.startswith("н"), 7).otherwise(30)
    return result.when(low.rlike(period), _plus_days(anchor, count * scale))


def entity_budget(text: Column, strict: bool = False) -> Column:
    """struct(min, max, currency, text) of the first budget pattern."""
    low = F.lower(text)
    number = r"(\d+[\s,]*\d*)"
    named = rf"(?U)бюджет[:\s]+(?:от\s+)?{number}\s*(?:до\s+{number})?\s*(₽|руб|рублей|тыс|тысяч|\$|долларов|usd)"
    bound = rf"(?U)(?:от|до)\s+{number}\s*(₽|руб|рублей|тыс|тысяч|\$|долларов)"
    dashed = rf"(?U){number}\s*[-–—]\s*{number}\s*(₽|руб|рублей|\$)"

    def value(pattern, group):
        digits = F.regexp_replace(F.regexp_extract(low, pattern, group), r"(?U)[\s,]", "")
        return F.when(digits != "", digits.try_cast("long"))

    def entity(pattern, low_group, high_group, currency_group):
        currency = F.regexp_extract(low, pattern, currency_group)
        factor = F.when(currency.startswith("тыс"), 1000).otherwise(1)
        first = value(pattern, low_group)
        last = F.coalesce(value(pattern, high_group), first) if high_group else first
        return F.when(
            low.rlike(pattern) & first.isNotNull(),
            F.struct(
                (first * factor).alias("min"),
                (last * factor).alias("max"),
                F.when(currency.startswith("тыс"), "₽").otherwise(currency).alias("currency"),
                F.regexp_extract(low, pattern, 0).alias("text"),
            ),
        )

    nothing = F.struct(
        F.lit(0).cast("long").alias("min"),
        F.lit(0).cast("long").alias("max"),
        F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("text"),
    )
    choices = [entity(named, 1, 2, 3)]
    if not strict:
        choices.append(entity(bound, 1, None, 2))
    choices.append(entity(dashed, 1, 2, 3))
    return F.coalesce(*choices, nothing)


def entity_urgency(text: Column) -> Column:
    low = F.lower(text)
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in URGENCY:
        result = result.when(low.rlike(U + pattern), label)
    return result


def money_strings(text: Column) -> Column:
    """All money strings, joined; null if there are none."""
    found = F.concat(*[F.transform(extract_all(text, U + p), lambda m: F.trim(m)) for p in MONEY_STRINGS])
    return F.when(F.size(found) > 0, F.array_join(found, ", "))
