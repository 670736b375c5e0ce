"""Candidates of similar texts: windows, status, exact prefixes, and groups that are split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import similarity, text as T
from siftline.operators import dedup, neighbours
from tests.test_dedup import jaccard, shingle_set

DAY = 86400


def stored(seed, n=120):
    """Messages in time order with copies, near copies far apart in time, and rejected ones."""
    rng = random.Random(seed)
    words = "нужен сайт авито директ бюджет магазин срочно реклама спец лендинг проект задача клиент отчёт тильда seo".split()
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(15)]
    rows = []
    for i in range(n):
        text = base[0] if i % 3 == 0 else rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            parts = text.split()
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        rows.append((i, text, 1_700_000_000 + i * DAY // 5 + rng.randrange(-DAY, DAY), rng.random() < 0.7))
    return rows + [(n, "", 1_700_000_000, True), (n + 1, "аб", 1_700_000_000, False), (n + 2, "А б", 1_900_000_000, True)]


def judge(rows, window=None, accepted=False, threshold=0.7):
    """Leader of each row: rows in order of id, the smallest earlier kept row that is similar, near in time and accepted."""
    firsts, kept, leader = {}, [], {}
    for i, text, at, ok in sorted(rows):
        key = "".join(text.lower().split())
        if key in firsts:
            first = firsts[key]
            leader[i] = first if leader[first] is None else leader[first]
            continue
        firsts[key] = i
        hits = [j for j, other, then in kept if jaccard(text, other) >= threshold and (window is None or abs(at - then) <= window)]
        leader[i] = min(hits) if hits else None
        if not hits and (ok or not accepted):
            kept.append((i, text, at))
    return leader


CASES = [(False, 8, 64, 3 * DAY, True), (False, 2, 2, None, True), (True, 2, 2, 3 * DAY, True), (True, 8, 64, 3 * DAY, False)]


@pytest.mark.parametrize("exact, crowd, rounds, window, accepted", CASES)
def test_window_and_status(spark, monkeypatch, exact, crowd, rounds, window, accepted):
    monkeypatch.setattr(neighbours, "CROWD", crowd)
    monkeypatch.setattr(neighbours, "ROUND", rounds)
    rows = stored(crowd)
    df = spark.createDataFrame(rows, "id LONG, text STRING, at LONG, ok BOOLEAN").withColumn("ts", F.timestamp_seconds("at"))
    found = dedup.near_duplicates(
        df, "id", "text", bands=64, rows=3, exact=exact, ts="ts" if window else None, window_seconds=window, accepted=F.col("ok") if accepted else None, copy=T.text_hash(F.col("text"))
    )
    got = {r["id"]: r["leader_id"] for r in found.collect()}
    want = judge(rows, window, accepted)
    assert got == want and 20 < sum(v is not None for v in want.values()) < 110


def test_exact_index_misses_no_pair(spark):
    """Pairs at the threshold itself, and above it by one shingle, among unrelated texts."""
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    rows, edge = [], 0
    for pair in range(40):
        size = rng.choice([12, 19, 36, 53])
        text = "".join(rng.sample(alphabet, size + 2))  # `size` shingles, all different
        changed = next(k for k in range(size, 0, -1) if k / (2 * size - k) < 0.7) + rng.choice([0, 1])  # common shingles
        other = text[: changed + 2] + "".join(rng.sample("abcdefghijklmnopqrstuvwxyz0123456789" * 3, size - changed))
        edge += jaccard(text, other) >= 0.7
        rows += [(2 * pair, text), (2 * pair + 1, other)]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "id LONG, text STRING"), "id", "text", exact=True).collect()
    got = {r["id"]: r["leader_id"] for r in found}
    texts = dict(rows)
    assert got == {i: i - 1 if i % 2 and jaccard(texts[i], texts[i - 1]) >= 0.7 else None for i in texts} and 5 < edge < 35


def test_exact_index_needs_a_threshold_above_a_half(spark):
    with pytest.raises(ValueError):
        dedup.near_duplicates(spark.createDataFrame([(1, "a")], "id LONG, text STRING"), "id", "text", threshold=0.5, exact=True)


def test_prefix_is_rarest_first(spark):
    texts = ["abcdef", "abcdeg", "abczzz", "abc"]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    counts = neighbours._frequencies(frame, 3)
    held = {}
    for t in texts:
        for s in shingle_set(t):
            held[s] = held.get(s, 0) + 1
    code = {s: int(similarity._encode(s, 3)[0]) for s in held}
    assert all(counts[code[s] & (neighbours.COUNTERS - 1)] >= n for s, n in held.items()) and counts.sum() == sum(held.values())
    for row in frame.select("t", similarity.prefix(3, 0.7, counts)("t").alias("s")).collect():
        n = len(shingle_set(row["t"]))
        assert row["s"]["first"] == n - int(np.ceil(0.7 * n - 1e-9)) + 1 and len(row["s"]["keys"]) == min(n, row["s"]["first"] + 1)
        sizes = [counts[k & (neighbours.COUNTERS - 1)] for k in row["s"]["keys"]]
        assert sizes == sorted(sizes)


def test_rare_codes_are_told_from_common_ones(spark):
    """Before, counters were so few that rare codes looked common: keys were shared by rows that are not alike, and split."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 6))) for _ in range(400)]
    frame = spark.createDataFrame([(" ".join(rng.choices(words, k=120)),) for _ in range(1500)], "t STRING").repartition(4).cache()
    counts = neighbours._frequencies(frame, 9)
    codes = [similarity._encode(r["t"], 9) for r in frame.collect()]
    found, held = np.unique(np.concatenate(codes), return_counts=True)
    told = counts[found & (neighbours.COUNTERS - 1)]
    assert (told >= np.minimum(held, 255)).all() and (told == held).mean() > 0.95


def test_pairs_that_share_too_few_keys_are_not_compared(spark, monkeypatch):
    """Texts that have a rare passage in common, besides near copies of some: only the copies are compared, and none is missed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    rows = []
    for i in range(40):
        passage = word()
        for side in range(2):
            rows.append((4 * i + side, " ".join([*(word() for _ in range(20)), passage])))
        copy = rows[-1][1].split(" ")
        copy[rng.randrange(20)] = word()
        rows.append((4 * i + 2, " ".join(copy)))
    compared = []
    real = neighbours.verified

    def counting(index, pairs):
        compared.append(pairs.select("id", "other").distinct().count())
        return real(index, pairs)

    monkeypatch.setattr(neighbours, "verified", counting)
    found = {r["id"]: r["leader_id"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "id LONG, text STRING"), "id", "text", shingle=5, exact=True).collect()}
    texts = dict(rows)
    similar = lambda a, b: len(x & y) / len(x | y) >= 0.7 if (x := {a[k : k + 5] for k in range(len(a) - 4)}) and (y := {b[k : k + 5] for k in range(len(b) - 4)}) else False
    want = {i: next((j for j in (i - 1, i - 2) if i % 4 == 2 and similar(texts[i], texts[j])), None) for i in texts}
    assert found == want and sum(v is not None for v in want.values()) > 20
    assert compared[-1] <= 45  # of the leaders, compared last: a row and its copy


@pytest.mark.parametrize("exact", [False, True])
def test_rows_compared_grow_with_the_rows(spark, monkeypatch, exact):
    """A crowd of near copies, and texts with a common frame that are not similar."""
    compared = []
    real = neighbours.verified

    def counting(index, pairs):
        made = neighbours.cut_lineage(pairs.select("id", "other").distinct())
        compared[-1] += made.count()
        return real(index, made)

    monkeypatch.setattr(neighbours, "verified", counting)
    for n in (60, 240):
        rng = random.Random(n)
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
        base, frame = [word() for _ in range(30)], [word() for _ in range(10)]
        rows = []
        for i in range(n):
            copy = base[:]
            copy[rng.randrange(30)] = word()
            rows += [(2 * i, " ".join(copy)), (2 * i + 1, " ".join([*frame, *(word() for _ in range(20))]))]
        compared.append(0)
        found = dedup.near_duplicates(spark.createDataFrame(rows, "id LONG, text STRING"), "id", "text", shingle=5, exact=exact).collect()
        assert {r["id"] for r in found if r["leader_id"] is not None} == {2 * i for i in range(1, n)}
    assert compared[1] <= 6 * compared[0] and compared[1] < 8 * 480


def test_clusters_through_the_exact_index(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CROWD", 2)
    rows = [(i, t) for i, t, _, _ in stored(7, 60)]
    found = dedup.near_clusters(spark.createDataFrame(rows, "id LONG, text STRING"), "id", "text", exact=True).collect()
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if j < i and (a.lower() == b.lower() or jaccard(a, b) >= 0.7 or (not shingle_set(a) and a == b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {r["id"]: r["cluster_id"] for r in found} == {i: find(i) for i, _ in rows}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id LONG, text STRING")
    assert dedup.near_duplicates(df, "id", "text").collect() == [] and dedup.near_duplicates(df, "id", "text", exact=True).collect() == []
    assert dedup.near_clusters(df, "id", "text").collect() == []


def test_exact_index_is_sent_by_value(spark):
    """Executors without the package get the functions themselves; a used Arrow function in their module must not travel with them."""
    import siftline
    from pyspark import cloudpickle

    spark.range(1).select(similarity.sequence_ratio(F.lit("a"), F.lit("b"))).collect()
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "The quick brown fox!"), (3, "another line of words")], "id long, text string")
    cloudpickle.register_pickle_by_value(siftline)
    try:
        found = {r["id"]: r["leader_id"] for r in dedup.near_duplicates(rows, "id", "text", exact=True).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(siftline)
    assert found == {1: None, 2: 1, 3: None}


def test_arrow_batches_are_bounded(spark):
    """Codes are many times as large as their texts: a worker holds those of a bounded batch, whatever the rows of a task."""
    rows_key, bytes_key = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows_key), spark.conf.get(bytes_key)
    try:
        for rows, size, want in (("10000", "64m", ("1000", str(8 << 20))), ("0", "-1", ("1000", str(8 << 20))), ("200", "1m", ("200", "1m"))):
            spark.conf.set(rows_key, rows)
            if size != "-1":
                spark.conf.set(bytes_key, size)
            similarity.sketch(9, 32, 4)
            similarity.shingle_codes(9)
            assert spark.conf.get(rows_key) == want[0]
            if size != "-1":
                assert int(spark.conf.get(bytes_key).rstrip("b")) == 8 << 20 if size == "64m" else spark.conf.get(bytes_key) in ("1m", f"{1 << 20}b")
    finally:
        spark.conf.set(rows_key, before[0])
        spark.conf.set(bytes_key, before[1])
