import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import cascade, filters, learning, logs, search, tables
from siftline.sources import files


def test_rules_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"positive": ["a"], "negative": ["б", "в"], "version": 3}, ensure_ascii=False, indent=1), "utf-8")
    rows = files.read_rules(spark, str(path)).collect()
    assert {(r["polarity"], r["pattern"]) for r in rows} == {("positive", "a"), ("negative", "б"), ("negative", "в")}
    assert files.read_rules(spark, str(tmp_path / "none.json")).count() == 0


def test_cases_and_corpus(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [
        {"case_id": "x", "specialization": "SEO", "niche": "n", "niche_keywords": ["k"], "results": {"m": "1"}}]}), "utf-8")
    row = files.read_cases(spark, str(tmp_path / "cases.json")).first()
    assert (row["case_id"], row["niche_keywords"], row["results"]) == ("x", ["k"], {"m": "1"})
    (tmp_path / "a.md").write_text("# Цены\nSEO от 30 тысяч", "utf-8")
    (tmp_path / "b.md").write_text("Команда", "utf-8")
    corpus = files.read_corpus(spark, str(tmp_path))
    assert {r["file"] for r in corpus.collect()} == {"a.md", "b.md"}
    hits = search.best_snippets(corpus, "file", "content", "какие цены тысяч").collect()
    assert [(r["file"], r["score"]) for r in hits] == [("a.md", 2)]
    stats = {r["extension"]: r for r in files.file_stats(spark, str(tmp_path)).collect()}
    assert stats["md"]["files"] == 2 and stats["md"]["lines"] == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id LONG, text STRING, is_relevant BOOLEAN")
    files.write_csv(df, str(tmp_path / "csv"), [F.desc("id")])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "text", "is_relevant"]
    files.write_json_by_relevance(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter("is_relevant = 'true'").count() == 1
    files.write_lines(df, "text", str(tmp_path / "lines"), [F.col("id")])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b"]


def test_logs(spark):
    lines = ["[1] ⏳ Chat A: processed 500 msgs...", "[1] ✅ DONE: Chat A (600 msgs)", "[2] ⚪ EMPTY: Chat B",
             "[3] ⏳ Chat C: processed 100 msgs...", "[3] ⏳ Chat C: processed 250 msgs...", "   ✅ Найдено! Score: 4, Spec: SEO", "x"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no LONG, value STRING")
    parsed = logs.parse(df)
    assert [r["kind"] for r in parsed.orderBy("line_no").collect()] == ["progress", "done", "empty", "progress", "progress", "lead", "other"]
    total = logs.totals(parsed, "line_no", 10_000).first()
    assert (total["chats_done"], total["scanned"], total["active"], total["percent"]) == (2, 850, 1, 8.5)


def test_upsert_keeps_first_write_and_is_idempotent(spark):
    schema = "hash STRING, id LONG, status STRING, last_seen LONG"
    stored = spark.createDataFrame([("h1", 1, "accepted", 10)], schema)
    incoming = spark.createDataFrame([("h1", 2, "rejected", 20), ("h2", 3, "rejected", 21), ("h2", 4, "accepted", 22)], schema)
    once = tables.upsert_first_wins(stored, incoming, "hash", ["id"], "last_seen", ["id", "status"])
    want = {("h1", 1, "accepted", 20), ("h2", 3, "rejected", 22)}
    assert {tuple(r) for r in once.collect()} == want
    twice = tables.upsert_first_wins(once, incoming, "hash", ["id"], "last_seen", ["id", "status"])
    assert {tuple(r) for r in twice.collect()} == want


def test_delete_needs_a_criterion(spark):
    with pytest.raises(ValueError):
        tables.delete_matching(spark.range(1), [])


def test_seed_if_empty(spark):
    seed, empty = spark.range(3), spark.range(0)
    assert tables.seed_if_empty(seed, empty).count() == 3 and tables.seed_if_empty(seed, spark.range(1)).count() == 0


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("100%",), ("1000",), (None,)], "t STRING")
    assert filters.search_any(df, ["t"], "0%").count() == 1
    assert filters.tokens_in_any(df, ["t"], "a").count() == 0


def test_configured(spark):
    df = spark.createDataFrame([("hot", "75")], "key STRING, value STRING")
    assert cascade.configured(df, "key", "value", {"hot": "70", "warm": "40"}).first().asDict() == {"hot": "75", "warm": "40"}


@pytest.mark.parametrize("scores", [[0.0, 1.0], [0.5, 0.5], [0.2, 0.9]])
def test_informativeness(spark, scores):
    import numpy as np

    p = np.array(scores)
    q = np.clip(p, 1e-10, 1 - 1e-10)
    entropy = np.mean(-(q * np.log2(q) + (1 - q) * np.log2(1 - q)))
    want = 0.25 * (1 - p.max()) + 0.35 * (1 - 2 * np.abs(p - 0.5).min()) + 0.2 * entropy + 0.2 * p.var()
    df = spark.createDataFrame([(1, scores)], "id LONG, scores ARRAY<DOUBLE>")
    assert learning.informativeness(df, "id").first()["informativeness"] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "outcome, want",
    [((False, 10, 9, True, 1e6), 0.0), ((True, 60, 1, False, None), 0.4), ((True, 7200, 5, True, 60000.0), 2.0),
     ((True, None, 3, True, 30000.0), 1.6), ((True, None, 0, True, None), 1.3)],
)
def test_reward(spark, outcome, want):
    df = spark.createDataFrame([outcome], "r BOOLEAN, s INT, n INT, c BOOLEAN, a DOUBLE")
    got = df.select(learning.reward(*[F.col(c) for c in "rsnca"]).alias("v")).first()["v"]
    assert got == pytest.approx(want)


def test_bandit_prefers_the_better_arm_and_repeats(spark):
    arms = [("good", 90.0, 10.0), ("bad", 10.0, 90.0)]
    picks = learning.select_strategy(spark.range(500), "id", arms, {}, epsilon=0.2)
    counts = {r["strategy"]: r["count"] for r in picks.groupBy("strategy").count().collect()}
    assert counts["good"] > 400 > counts["bad"] > 10
    assert picks.orderBy("id").collect() == learning.select_strategy(spark.range(500), "id", arms, {}).orderBy("id").collect()


def test_classifier_learns_saves_and_loads(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(i, ("нужен сайт срочно" if i % 2 else "предлагаю услуги дёшево") + f" номер {i % 7}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id LONG, text STRING, label INT")
    model, scores = learning.train(df, "id", "text", "label")
    assert scores["test_accuracy"] > 0.9 and scores["rows"] == 80
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    a = learning.predict(model, df.select("id", "text")).orderBy("id").collect()
    assert a == learning.predict(again, df.select("id", "text")).orderBy("id").collect()
    assert learning.train(df.limit(10), "id", "text", "label")[0] is None
    untrained = learning.predict(None, df.select("id")).first()
    assert (untrained["is_lead"], untrained["probability"]) == (False, 0.0)


def test_common_grams_are_counted_without_those_of_rare_words(spark, monkeypatch):
    """The same grams as the vectorizer's, of which only those that can be frequent enough are counted."""
    rng = random.Random(4)
    words = [f"w{i:03d}" for i in range(300)]
    rows = [(" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(0, 60))),) for _ in range(200)]
    rows = [(i, *row) for i, row in enumerate([*rows, ("once once once once",), ("",)])]
    df = spark.createDataFrame(rows, "id LONG, text STRING").repartition(3)
    *cutting, vectorizer, _ = learning.text_features(df, "text").getStages()
    tokens = cutting[0].transform(df)
    grams = tokens
    for stage in cutting[1:]:
        grams = stage.transform(grams)
    held = grams.select("id", F.explode("_grams").alias("g")).groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("rows")
    ).where("rows > 1").collect()
    want = [r["g"] for r in sorted(held, key=lambda r: (-r["n"], r["g"]))]
    assert any(g.count(" ") == 2 for g in want[:400])
    counted = []
    real = learning._gram_counts
    monkeypatch.setattr(learning, "_gram_counts", lambda *a: counted.append(real(*a)) or counted[-1])
    for most in (40, 400, 100_000):
        assert learning.common_grams(tokens, "_words", most) == want[:most]
    assert set(vectorizer.fit(grams).vocabulary) == set(want[:1000]) or len(want) > 1000
    pairs = {r["g"] for r in grams.select(F.explode("_grams").alias("g")).collect() if r["g"].count(" ") == 1}
    assert 0 < 2 * counted[1].count() < len(pairs)  # for the 40 most frequent: pairs of frequent words only


def test_rows_of_a_class_stay_spread(spark):
    """Weights and the split join a few rows to many: no task may get all rows of a class, whatever the planner estimates."""
    rows = spark.range(4000, numPartitions=8).select(F.col("id"), (F.col("id") % 2).cast("double").alias("label"))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, "-1")
        train, test = learning.stratified_split(rows, "id", "label")
        weighted = learning.balanced(train, "label").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    sizes = [sum(r["task"] == task for r in weighted) for task in {r["task"] for r in weighted}]
    assert len(weighted) + test.count() == 4000 and max(sizes) <= 500
    assert sum(r["weight"] for r in weighted) == pytest.approx(len(weighted))
