from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import numbers


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, documented, strict",
    [
        ("пятьдесят тысяч", 50000, 50000),
        ("сто двадцать пять", 125, 125),
        ("три с половиной тысячи", 3500, 3000),
        ("50к", 50000, 50000),
        ("2.5 млн", 2500000, 1000000),
        ("50 тысяч", 50000, 1000),
        ("10 000", 10000, 10),
        ("ничего", None, None),
    ],
)
def test_text_to_number(spark, text, documented, strict):
    assert value(spark, numbers.text_to_number(F.lit(text))) == documented
    assert value(spark, numbers.text_to_number(F.lit(text), strict=True)) == strict


@pytest.mark.parametrize(
    "text, low, high",
    [
        ("от 50 до 100 тысяч", 50000, 100000),
        ("бюджет до 200к", None, 200000),
        ("примерно 75 тыс", 75000, 75000),
        ("от 30 тысяч", 30000, None),
        ("бюджет 50 000 руб", 50000, 50000),
        ("цена договорная", None, None),
    ],
)
def test_budget_range(spark, text, low, high):
    got = value(spark, numbers.budget_range(F.lit(text)))
    assert (got["min"], got["max"]) == (low, high)


def test_budget_range_strict(spark):
    got = value(spark, numbers.budget_range(F.lit("от 50 до 100 тысяч"), strict=True))
    assert (got["min"], got["max"]) == (50, 100)


@pytest.mark.parametrize(
    "text, anchor, expected",
    [
        ("Срочно!", datetime(2024, 5, 8, 10), datetime(2024, 5, 8, 10)),
        ("завтра", datetime(2024, 5, 8, 10), datetime(2024, 5, 9, 10)),
        ("послезавтра", datetime(2024, 5, 8, 10), datetime(2024, 5, 10, 10)),
        ("до конца недели", datetime(2024, 5, 5, 10), datetime(2024, 5, 12, 10)),  # a Sunday
        ("до конца недели", datetime(2024, 5, 6, 10), datetime(2024, 5, 12, 10)),  # a Monday
        ("до конца месяца", datetime(2024, 2, 3, 10), datetime(2024, 2, 29, 10)),
        ("до 25 числа", datetime(2024, 5, 8, 10), datetime(2024, 5, 25, 10)),
        ("до 25 числа", datetime(2024, 5, 26, 10), datetime(2024, 6, 25, 10)),
        ("через две недели", datetime(2024, 5, 8, 10), datetime(2024, 5, 22, 10)),
        ("через 3 дня", datetime(2024, 5, 8, 10), datetime(2024, 5, 11, 10)),
        ("когда-нибудь", datetime(2024, 5, 8, 10), None),
    ],
)
def test_deadline(spark, text, anchor, expected):
    moment = F.lit(anchor.isoformat(sep=" ")).cast("timestamp")
    got = value(spark, numbers.deadline(F.lit(text), moment).cast("string"))
    assert got == (None if expected is None else expected.isoformat(sep=" "))


def test_deadline_strict_keeps_first_period(spark):
    moment = F.lit("2024-05-08 10:00:00").cast("timestamp")
    got = value(spark, numbers.deadline(F.lit("послезавтра"), moment, strict=True).cast("string"))
    assert got == "2024-05-09 10:00:00"


@pytest.mark.parametrize(
    "text, low, high, currency",
    [
        ("Бюджет: от 10 до 20 тыс", 10000, 20000, "₽"),
        ("бюджет 30000 руб", 30000, 30000, "руб"),
        ("от 500 $", 500, 500, "$"),
        ("100 - 200 ₽", 100, 200, "₽"),
        ("даром", 0, 0, None),
    ],
)
def test_entity_budget(spark, text, low, high, currency):
    got = value(spark, numbers.entity_budget(F.lit(text)))
    assert (got["min"], got["max"], got["currency"]) == (low, high, currency)


def test_entity_budget_strict_skips_bounds(spark):
    assert value(spark, numbers.entity_budget(F.lit("от 500 $"), strict=True))["min"] == 0


@pytest.mark.parametrize(
    "text, expected",
    [("срочно и сегодня", "urgent"), ("ASAP", "asap"), ("сегодня", "today"), ("завтра", "tomorrow"),
     ("на этой неделе", "this_week"), ("до 5 мая", "specific_date"), ("не к спеху", None)],
)
def test_urgency(spark, text, expected):
    assert value(spark, numbers.entity_urgency(F.lit(text))) == expected


def test_money_strings(spark):
    assert value(spark, numbers.money_strings(F.lit("оплата: 500 руб"))) == "500 руб, оплата: 500 руб"
    assert value(spark, numbers.money_strings(F.lit("бесплатно"))) is None
