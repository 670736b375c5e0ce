"""Streams give what the batch forms give, in one and in several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.lexicons.builtin import RUSSIAN
from siftline.operators import cascade, dedup, sessions
from siftline.streaming import jobs

SCHEMA = "event_id LONG, ts TIMESTAMP, key STRING, value DOUBLE, text STRING, outgoing BOOLEAN"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(20 * 86400), f"k{rng.randrange(6)}", float(rng.randrange(100)), f"m{i}", rng.random() < 0.5)
            for i in range(400)]
    df = spark.createDataFrame(rows, "event_id LONG, at INT, key STRING, value DOUBLE, text STRING, outgoing BOOLEAN")
    return df.select("event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("ts"), "key", "value",
                     "text", "outgoing").cache()


def feed(events, path, parts):
    """Files in time order, one per micro-batch."""
    bounds = events.agg(F.min(F.unix_seconds("ts")).alias("lo"), F.max(F.unix_seconds("ts")).alias("hi")).first()
    step = (bounds["hi"] - bounds["lo"]) / parts + 1
    part = F.floor((F.unix_seconds("ts") - bounds["lo"]) / step)
    for i in range(parts):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(path)


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return df.sparkSession.table(name)


@pytest.mark.parametrize("parts", [1, 4])
def test_dedup_ttl(spark, events, tmp_path, parts):
    feed(events, str(tmp_path / "in"), parts)
    stream = jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)
    got = run(jobs.dedup_ttl(stream, "key", "ts", "event_id", 48 * 3600, "1 hour"), f"dedup{parts}")
    want = dedup.ttl_anchors(events, "key", "ts", 48 * 3600)
    pairs = lambda df: sorted((r[0], str(r[1])) for r in df.collect())
    assert pairs(got.select("key", F.col("anchor").cast("timestamp_ntz"))) == pairs(want.select("key", "anchor"))


@pytest.mark.parametrize("parts", [1, 3])
def test_token_bucket(spark, events, tmp_path, parts):
    feed(events, str(tmp_path / "in"), parts)
    stream = jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)
    got = run(jobs.token_bucket(stream, "key", "ts", "event_id", 2, 1 / 36000, 5 * 86400, "1 hour"), f"bucket{parts}")
    start, step, outputs = sessions.token_bucket(2, 1 / 36000)
    want = sessions.ordered_fold(events, "key", "ts", "event_id", [], start, step, outputs, 86400)
    allowed = lambda df: {r["event_id"]: r["allowed"] for r in df.collect()}
    assert allowed(got) == allowed(want)


def test_hourly_tiers(spark, events, tmp_path):
    feed(events, str(tmp_path / "in"), 3)
    stream = jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)
    got = run(jobs.hourly_tiers(stream, "ts", "value", "1 hour"), "hourly", "complete")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), cascade.tier_of(F.col("value")).alias("tier")).count()
    assert sorted((str(r[0]), r[1], r[2]) for r in got.select("hour_start", "tier", "n").collect()) == sorted(
        (str(r[0]), r[1], r[2]) for r in want.select("w.start", "tier", "count").collect()
    )


def test_sessions(spark, events, tmp_path):
    feed(events, str(tmp_path / "in"), 2)
    stream = jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)
    gap = F.when(F.col("value") > 50, "4 hours").otherwise("2 hours")
    got = run(jobs.sessions(stream, "key", "ts", "text", gap, "1 hour"), "sess")
    want = events.groupBy("key", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("messages"))
    batch = {(r["key"], str(r["start"])): r["messages"] for r in want.select("key", "s.start", "messages").collect()}
    seen = {(r["key"], str(r["session_start"])): r["messages"] for r in got.collect()}
    assert seen and all(batch[k] == n for k, n in seen.items())
    assert len(batch) - len(seen) <= 12  # sessions near the end stay open until the watermark passes


def test_follow_ups(spark, tmp_path):
    rows = [(1, 0, "quiet", True), (2, 0, "talks", True), (3, 86400 * 2, "talks", False), (4, 86400 * 30, "clock", True),
            (5, 86400 * 31, "clock", True), (6, 86400 * 32, "clock", True)]
    df = spark.createDataFrame(rows, "event_id LONG, at INT, key STRING, outgoing BOOLEAN").select(
        "event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("ts"), "key",
        F.lit(0.0).alias("value"), F.lit("").alias("text"), "outgoing")
    for i in range(1, 7):
        df.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)
    got = run(jobs.follow_ups(stream, "key", "ts", "outgoing", [86400, 3 * 86400, 5 * 86400], "1 hour"), "ladder")
    levels = sorted((r["key"], r["level"]) for r in got.collect() if r["key"] != "clock")
    assert levels[-1][0] in ("quiet", "talks") and ("quiet", 1) in levels
    assert ("quiet", 2) in levels


def test_triage_stream_upserts(spark, tmp_path):
    first = [(1, "Нужен seo специалист для магазина, бюджет 50000 руб", "any"), (2, "легкий заработок для всех дома сейчас", "any")]
    second = [(3, "нужен SEO специалист для магазина, бюджет 50000 руб", "any"), (4, "Нужен сайт для новой клиники в Москве", "any")]
    for rows in (first, second):
        spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), "doc_id LONG, text STRING, source STRING", per_trigger=1)
    query = jobs.triage(stream, RUSSIAN, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(180)
    assert query.exception() is None
    got = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 4} and got[1]["last_seen"] == 3 and got[2]["stage"] == "LEVEL_1_HARD_BLOCK"
    # a repeated batch changes nothing
    batch = spark.read.parquet(str(tmp_path / "out")).drop("bucket")
    jobs.upsert_batch(str(tmp_path / "out"))(batch, 9)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def upserts():
    first = [("a", 1, "x", 10), ("b", 2, "y", 11), ("a", 3, "z", 12)]
    return first, [("c", 4, "x", 20), ("a", 5, "w", 21)]


def test_upsert_does_not_take_a_broken_table_for_an_empty_one(spark, tmp_path):
    first, second = (spark.createDataFrame(rows, "hash STRING, doc_id LONG, stage STRING, last_seen LONG") for rows in upserts())
    path = tmp_path / "out"
    jobs.upsert_batch(str(path))(first, 0)
    for file in path.rglob("*.parquet"):
        file.chmod(0o644)
        file.write_bytes(b"not parquet")
    before = {f: f.read_bytes() for f in path.rglob("*.parquet")}
    with pytest.raises(Exception):
        jobs.upsert_batch(str(path))(second, 1)
    assert {f: f.read_bytes() for f in path.rglob("*.parquet") if f in before} == before


def test_appended_batches_fold_to_the_upserted_table(spark, tmp_path):
    batches = [spark.createDataFrame(rows, "hash STRING, doc_id LONG, stage STRING, last_seen LONG") for rows in upserts()]
    for name, sink in (("upserted", jobs.upsert_batch), ("appended", jobs.append_batch)):
        for i in (0, 1, 1):  # the last batch is repeated
            sink(str(tmp_path / name))(batches[i], i)
    columns = ["hash", "doc_id", "stage", "last_seen"]
    want = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "upserted")).select(columns).collect())
    assert want == [("a", 1, "x", 21), ("b", 2, "y", 11), ("c", 4, "x", 20)]
    assert sorted(tuple(r) for r in jobs.folded(spark, str(tmp_path / "appended")).select(columns).collect()) == want
    jobs.compact(spark, str(tmp_path / "appended"), str(tmp_path / "compacted"))
    assert sorted(tuple(r) for r in jobs.folded(spark, str(tmp_path / "compacted")).select(columns).collect()) == want
