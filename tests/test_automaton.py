"""One pass for many patterns against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import automaton
from siftline.lexicons.builtin import RUSSIAN
from siftline.operators import cascade

WORDS = ["а", "аб", "ба", "абв", "x", "xx", "x.x", "𝒳y", "", "нужен", "не"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("абвx. 𝒳yнеуж", k=rng.randint(0, 25))) for _ in range(n)]


def test_first_places_equal_plain_search():
    made = automaton._automaton(automaton._key(WORDS), WORDS)
    for text in texts(500):
        assert automaton.first_places(made, WORDS, text) == {i: text.find(w) + 1 for i, w in enumerate(WORDS) if w in text}
    assert automaton.first_places(automaton._automaton("none", []), [], "text") == {}
    assert len(automaton._made) <= automaton.KEPT


@pytest.mark.parametrize("size", [8_000_000, 20])
def test_multi_match(spark, monkeypatch, size):
    """Rules in one part and in several, equal patterns, nulls, and rows of equal ids."""
    monkeypatch.setattr(automaton, "PART_BYTES", size)
    rows = list(enumerate(texts(80))) + [(3, "абв"), (None, "аб"), (900, None), (901, "")]
    rules = [(i, w) for i, w in enumerate(WORDS)] + [(50, "аб"), (51, None)]
    df = spark.createDataFrame(rows, "id LONG, text STRING")
    got = automaton.multi_match(df, "id", "text", spark.createDataFrame(rules, "rule INT, p STRING"), "rule", "p").collect()
    want = [(i, r, t.find(w) + 1) for i, t in rows if t is not None for r, w in rules if w is not None and w in t]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert automaton.multi_match(df, "id", "text", spark.createDataFrame([], "rule INT, p STRING"), "rule", "p").collect() == []
    assert automaton.multi_match(df.where("false"), "id", "text", spark.createDataFrame(rules, "rule INT, p STRING"), "rule", "p").collect() == []


def test_direction_in_one_pass_is_the_direction_score(spark):
    """The whole vocabulary, in the contexts that change weights."""
    rng = random.Random(5)
    words = [w for ws in RUSSIAN.directions.values() for w in ws]
    frames = ["{} и {}", "Нужен {}, {}", "не нужен {}, без {}", "у нас есть {}; ищем {}", "{} не требуется, {}", "сами веду {} " + "x" * 100 + " {}"]
    made = [rng.choice(frames).format(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words), rng.choice(words)) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in [*made, "", None, "ничего такого"]], "t STRING")
    rows = df.select("t", cascade.direction_score(F.col("t"), RUSSIAN).alias("a"), cascade.direction_of(F.col("t"), RUSSIAN).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["t"] is None for r in rows)
    assert len({r["b"] for r in rows}) == 9
    own = {"первый": ["сайт", "сайт"], "второй": ["лендинг"]}
    listed = df.limit(1).select(cascade.direction_of(F.lit("лендинг, сайт"), RUSSIAN, own).alias("d"), cascade.direction_of(F.lit("x"), RUSSIAN, {"a": []}).alias("e"))
    assert tuple(listed.first()) == ("первый", "Unknown")


def test_cost_does_not_grow_with_the_vocabulary():
    import time

    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000))
    spent = []
    for n in (1_000, 100_000):
        words = ["".join(rng.choices("ijklmnop", k=8)) for _ in range(n)]
        made = automaton._automaton(automaton._key(words), words)
        started = time.process_time()
        for _ in range(5):
            automaton.first_places(made, words, text)
        spent.append(time.process_time() - started)
    assert spent[1] < 5 * spent[0] + 0.2
