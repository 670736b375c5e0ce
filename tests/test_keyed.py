"""Chunked windows against plain windows, with a key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.operators import keyed, sessions


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(20)}"
        at = f"2024-01-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"
        data.append((i, key, at, rng.choice(["a", "b", None]), rng.randrange(100)))
    df = spark.createDataFrame(data, "id LONG, key STRING, at STRING, kind STRING, v INT")
    return df.select("id", "key", F.col("at").cast("timestamp_ntz").alias("ts"), "kind", "v").cache()


def day():
    return F.date_trunc("day", F.col("ts"))


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def test_previous_value(rows):
    for inclusive in (False, True):
        got = keyed.previous_value(rows, ["key"], ["ts", "id"], F.col("kind"), day(), "p", inclusive)
        w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        same(got.select("id", "p"), rows.select("id", F.last("kind", True).over(w).alias("p")))


def test_running_sum(rows):
    got = keyed.running_sum(rows, ["key"], ["ts", "id"], F.col("v"), day(), "s")
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(got.select("id", "s"), rows.select("id", F.sum("v").over(w).alias("s")))


def test_global_row_number(rows):
    got = keyed.global_row_number(rows, "id", F.floor(F.col("id") / 50), "n")
    same(got.select("id", "n"), rows.select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("n")))


def test_top_n(rows):
    got = keyed.top_n_per_key(rows, ["key"], [F.desc("v"), F.asc("id")], 5, ["id"], salts=7)
    w = Window.partitionBy("key").orderBy(F.desc("v"), "id")
    same(
        got.select("id", "rank_in_key"),
        rows.withColumn("rank_in_key", F.row_number().over(w)).filter("rank_in_key <= 5").select("id", "rank_in_key"),
    )


def test_trailing_window(rows):
    got = keyed.rows_in_trailing_window(rows, ["key"], "id", "ts", 86400, 3600, "n")
    a, b = rows.alias("a"), rows.alias("b")
    brute = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id"))
               & (F.col("b.ts") <= F.col("a.ts")) & (F.col("b.ts") >= F.col("a.ts") - F.expr("INTERVAL 24 HOUR")), "left")
        .groupBy("a.id").agg(F.count("b.id").alias("n"))
    )
    same(got.select("id", "n"), brute.select("id", "n"))


def test_trailing_window_of_copies_ties_and_nulls(spark):
    """Each row counts all others of its window: those of its own instant, its copies, and those of null keys."""
    rng = random.Random(11)
    data = [(rng.randrange(150), rng.choice(["a", "b", None]), f"2024-01-{rng.randrange(1, 6):02d} {rng.randrange(24):02d}:00:00") for _ in range(300)]
    data += [(i, None, None) for i in range(5)]
    odd = spark.createDataFrame(data, "id LONG, key STRING, at STRING").select("id", "key", F.col("at").cast("timestamp_ntz").alias("ts"))
    got = keyed.rows_in_trailing_window(odd, ["key"], "id", "ts", 86400, 3600, "n")
    w = Window.partitionBy("key").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-86400, 0)
    same(got.select("key", "id", "n"), odd.select("key", "id", (F.count(F.lit(1)).over(w) - 1).alias("n")))


def test_sessionize(rows):
    got = keyed.sessionize(rows, ["key"], "ts", "id", F.lit(3600), day()).select("id", "session_start")
    w = Window.partitionBy("key").orderBy("ts", "id")
    opened = F.when(
        F.lag("ts").over(w).isNull() | (F.col("ts") >= F.lag("ts").over(w) + F.expr("INTERVAL 1 HOUR")), F.col("ts")
    )
    flat = rows.withColumn("o", opened)
    same(got, flat.select("id", F.last("o", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")))


def brute_bucket(rows, capacity, rate):
    out = {}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["key"], []).append((r["ts"].timestamp(), r["id"]))
    for items in groups.values():
        tokens, last = float(capacity), None
        for at, i in sorted(items):
            tokens = min(capacity, tokens + (at - (last if last is not None else at)) * rate)
            last = at
            ok = tokens >= 1
            tokens -= 1 if ok else 0
            out[i] = ok
    return out


@pytest.mark.parametrize("gap", [None, 2 * 7200])
def test_token_bucket_also_for_keys_cut_at_silences(rows, gap):
    start, step, outputs = sessions.token_bucket(2, 1 / 7200)
    got = sessions.ordered_fold(rows, "key", "ts", "id", [], start, step, outputs, 5 * 86400, gap)
    assert {r["id"]: r["allowed"] for r in got.collect()} == brute_bucket(rows, 2, 1 / 7200)


def test_token_bucket_burst(spark):
    burst = spark.createDataFrame([(i, "u") for i in range(35)], "id LONG, key STRING").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    )
    start, step, outputs = sessions.token_bucket(30, 30.0)
    got = sessions.ordered_fold(burst, "key", "ts", "id", [], start, step, outputs, 60).collect()
    assert sum(r["allowed"] for r in got) == 30 and all(r["wait_seconds"] >= 0 for r in got)


def test_circuit(spark):
    calls = [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (70, 1), (75, 0), (140, 0), (141, 1)]
    df = spark.createDataFrame([(i, "s", at, bad) for i, (at, bad) in enumerate(calls)], "id LONG, key STRING, at INT, bad INT")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")))
    start, step, outputs = sessions.circuit()
    got = {r["id"]: (r["state"], r["called"]) for r in
           sessions.ordered_fold(df, "key", "ts", "id", ["bad"], start, step, outputs, 3600).collect()}
    assert got[4] == ("CLOSED", True) and got[5] == ("OPEN", False)
    assert got[6] == ("HALF_OPEN", True) and got[7] == ("OPEN", False)
    assert got[8] == ("HALF_OPEN", True) and got[9] == ("CLOSED", True)


def test_debounce(spark):
    data = [(1, 0, "a"), (2, 3, "b"), (3, 4, "c"), (4, 7, "d"), (5, 400, "e"), (6, 404, "f")]
    df = spark.createDataFrame(data, "id LONG, at INT, text STRING").select(
        "id", F.lit("u").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("ts"), "text"
    )
    got = sessions.debounce(df, "key", "ts", "id", "text", day()).orderBy("session_start").collect()
    # the first message waits 7 s; the next ones follow within five minutes of another and wait 2 s
    assert [r["merged"] for r in got] == ["a\nb\nc", "d", "e\nf"]
