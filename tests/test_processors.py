"""Processors with state and timers give what the batch forms give, in one and in several micro-batches."""

import pytest
from pyspark.sql import functions as F
from tests.test_streaming import SCHEMA, events, feed  # noqa: F401

from siftline.operators import dedup, sessions
from siftline.streaming import jobs, processors


def stream(spark, events, tmp_path, parts):  # noqa: F811
    feed(events, str(tmp_path / "in"), parts)
    return jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)


@pytest.mark.parametrize("parts", [1, 4])
def test_ttl_anchors(spark, events, tmp_path, parts):  # noqa: F811
    got = processors.drained(processors.ttl_anchors(stream(spark, events, tmp_path, parts), "key", "ts", "event_id", 48 * 3600, "1 hour"), str(tmp_path / "out"))
    want = dedup.ttl_anchors(events, "key", "ts", 48 * 3600)
    rows = lambda df, at: sorted((r[0], r[1]) for r in df.select("key", at).collect())
    assert rows(got, F.col("at")) == rows(want, F.unix_micros(F.col("anchor").cast("timestamp")))
    ids = {r["event_id"]: r["key"] for r in events.collect()}
    assert all(ids[r["id"]] == r["key"] for r in got.collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_breakers(spark, events, tmp_path, parts):  # noqa: F811
    start, step, outputs = sessions.circuit(failures=2, cool_down=20_000)
    failing = F.col("value") > 60
    source = stream(spark, events, tmp_path, parts).withColumn("failed", failing.cast("int"))
    got = processors.drained(processors.breakers(source, "key", "ts", "event_id", "failed", start, step, 40_000, "1 hour"), str(tmp_path / "out"))
    want = sessions.ordered_fold(events.withColumn("failed", failing.cast("int")), "key", "ts", "event_id", ["failed"], start, step, outputs, 86400)
    assert {r["id"]: (r["state"], r["called"]) for r in got.collect()} == {r["event_id"]: (r["state"], r["called"]) for r in want.collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_idle_keys(spark, tmp_path, parts):
    hours = {"early": [0, 1, 5], "late": [90, 95], "twice": [2, 3, 70], "end": [100]}
    rows = [(i, h * 3600, k) for i, (k, h) in enumerate((k, h) for k, hs in hours.items() for h in hs)]
    df = spark.createDataFrame(rows, "event_id LONG, at LONG, key STRING").select(
        "event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("ts"), "key", F.lit(0.0).alias("value"), F.lit("").alias("text"), F.lit(True).alias("outgoing")
    )
    got = processors.drained(processors.idle_keys(stream(spark, df, tmp_path, parts), "key", "ts", 10 * 3600), str(tmp_path / "out"))
    made = sorted((r["key"], (r["at"] // 1_000_000 - 1_700_000_000) // 3600, r["events"]) for r in got.collect())
    # the last silences of `late` and `end` are not over when the input ends
    assert made == [("early", 5, 3), ("twice", 3, 2), ("twice", 70, 1)]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(processors.PROVIDER, None)
    with processors.rocks_state(spark):
        assert spark.conf.get(processors.PROVIDER) == processors.ROCKS
    assert spark.conf.get(processors.PROVIDER, None) == before
