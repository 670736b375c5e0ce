"""The term index against the scan, and random draws against their distributions."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import learning, search

QUESTIONS = ["which license covers threat tokens", "licen licen threat", "ÜBER straße", "no such words", "abc de", "the the"]


def test_index_gives_the_rows_of_the_scan(spark, tmp_path):
    rng = random.Random(3)
    words = ["license", "licensed", "LICENSE", "which", "threatens", "token", "tokens", "überall", "Straße", "x1", "the", "discovers"]
    marks = [" ", ", ", "-", "\n", "'s "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 5, 400])))) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "id LONG, body STRING")
    index = search.build_index(df, "id", "body", str(tmp_path / "index"))
    for question in QUESTIONS:
        for top in (2, 50):
            want = [tuple(r) for r in search.best_snippets(df, "id", "body", question, top).collect()]
            got = [tuple(r) for r in search.indexed_snippets(index, df, "id", "body", question, top).collect()]
            assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        search.indexed_snippets(index, df, "id", "body", "what-ever")


def test_index_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id LONG, body STRING")
    assert search.indexed_snippets(search.build_index(df, "id", "body", str(tmp_path / "i")), df, "id", "body", QUESTIONS[0]).collect() == []


@pytest.mark.parametrize("alpha, beta", [(12.0, 8.0), (1.0, 1.0), (0.5, 0.5), (40.0, 2.0)])
def test_beta_draws(spark, alpha, beta):
    df = spark.range(20_000).select(learning.beta_draw(F.col("id"), 7, "x", alpha, beta).alias("b"))
    low, high, mean, var = df.agg(F.min("b"), F.max("b"), F.avg("b"), F.var_pop("b")).first()
    n = alpha + beta
    assert 0 <= low and high <= 1 and abs(mean - alpha / n) < 0.01
    assert abs(var - alpha * beta / (n * n * (n + 1))) < 0.05 * alpha * beta / (n * n * (n + 1)) + 0.0005


def test_sampled_choice(spark):
    arms = [("a", 30.0, 10.0), ("b", 10.0, 30.0), ("c", 1.0, 60.0)]
    rows = learning.sample_strategy(spark.range(6000).withColumnRenamed("id", "k"), "k", arms, {"b": F.when(F.col("k") < 3000, 9.0).otherwise(1.0)}).collect()
    free = [r for r in rows if r["explored"]]
    assert 0.17 < len(free) / len(rows) < 0.23 and all(0.27 < sum(r["strategy"] == n for r in free) / len(free) < 0.40 for n in "abc")
    chosen = [r for r in rows if not r["explored"]]
    assert sum(r["strategy"] == "b" for r in chosen if r["k"] < 3000) > 2300 and sum(r["strategy"] == "a" for r in chosen if r["k"] >= 3000) > 2300
    again = learning.sample_strategy(spark.range(6000).repartition(3).withColumnRenamed("id", "k"), "k", arms, {"b": F.when(F.col("k") < 3000, 9.0).otherwise(1.0)})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
