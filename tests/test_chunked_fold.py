"""Chunks of a key folded in parallel give what the fold of the whole key gives."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import sessions

START = 1_700_000_000


def calls(spark, rows):
    return spark.createDataFrame(rows, "id LONG, at DOUBLE, key STRING, failed INT").withColumn("ts", F.timestamp_seconds("at"))


def plain(rows, start, step, extra):
    states, out = {}, {}
    for i, at, key, failed in sorted(rows, key=lambda r: (r[1], r[0])):
        states[key], out[i] = step(states.get(key, dict(start)), at, *([failed] if extra else []))
    return out


@pytest.mark.parametrize("rate", [0.05, 0.5, 0.95])
def test_one_hot_key(spark, rate):
    """Failures that seldom, often and nearly always keep the breaker open over the borders of chunks."""
    rng = random.Random(int(rate * 100))
    rows = [(i, START + rng.randrange(0, 40_000) / 2, rng.choice(["hot", "hot", "hot", "a", None]), int(rng.random() < rate)) for i in range(1500)]
    start, step, outputs = sessions.circuit(failures=3, cool_down=400)
    for width in (300, 5000, 10**9):
        got = sessions.chunked_fold(calls(spark, rows), "key", "ts", "id", ["failed"], start, step, outputs, width).collect()
        assert {r["id"]: (r["state"], r["called"]) for r in got} == plain(rows, start, step, True)
    assert {r["id"]: r["key"] for r in got} == {r[0]: r[2] for r in rows}


def test_token_bucket(spark):
    rng = random.Random(8)
    rows = [(i, START + float(rng.randrange(0, 3000)), "hot", 0) for i in range(800)]
    start, step, outputs = sessions.token_bucket(5, 1 / 4)
    got = sessions.chunked_fold(calls(spark, rows), "key", "ts", "id", [], start, step, outputs, 200).collect()
    assert {r["id"]: (r["allowed"], r["wait_seconds"]) for r in got} == plain(rows, start, step, False)


def test_work_is_spread_and_few_chunks_are_folded_again(spark):
    rows = [(i, START + float(i), "hot", int(i % 7 == 0)) for i in range(4000)]
    start, step, outputs = sessions.circuit(failures=2, cool_down=60)
    steps = spark.sparkContext.accumulator(0)

    def counted(state, at, failed):
        steps.add(1)
        return step(state, at, failed)

    got = sessions.chunked_fold(calls(spark, rows), "key", "ts", "id", ["failed"], start, counted, outputs, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        spread = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 4 and max(r["count"] for r in spread) < 2000
    assert steps.value < 3 * len(rows)


@pytest.mark.parametrize("rows_of_a_chunk", [10**6, 70])
def test_chunks_by_rows(spark, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(sessions, "CHUNK_ROWS", rows_of_a_chunk)
    rng = random.Random(4)
    rows = [(i, START + rng.randrange(0, 9000) / 4, rng.choice(["hot", "a", None]), int(rng.random() < 0.4)) for i in range(600)]
    start, step, outputs = sessions.circuit(failures=2, cool_down=90)
    got = sessions.chunked_fold(calls(spark, rows), "key", "ts", "id", ["failed"], start, step, outputs).collect()
    assert {r["id"]: (r["state"], r["called"]) for r in got} == plain(rows, start, step, True)


def test_empty(spark):
    start, step, outputs = sessions.circuit()
    assert sessions.chunked_fold(calls(spark, []), "key", "ts", "id", ["failed"], start, step, outputs, 60).collect() == []
