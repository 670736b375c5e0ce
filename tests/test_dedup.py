"""Deduplication against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import similarity
from siftline.operators import dedup


def shingle_set(text, size=3):
    clean = "".join(c for c in text.lower() if c.isalnum() or c.isspace())
    return {clean[i : i + size] for i in range(len(clean) - size + 1)}


def jaccard(a, b, size=3):
    x, y = shingle_set(a, size), shingle_set(b, size)
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.fixture(scope="module")
def messages():
    rng = random.Random(11)
    words = "нужен сайт авито директ бюджет магазин срочно реклама спец лендинг проект задача клиент отчёт тильда seo".split()
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(25)]
    texts = []
    for i in range(90):
        text = base[0] if i % 3 == 0 else rng.choice(base)  # one message holds a third of all rows
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            parts = text.split()
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        texts.append((i, text))
    return texts + [(90, ""), (91, "аб"), (92, "аб")]


def greedy(rows, threshold=0.7, size=3):
    """Rows in id order; a row is compared with kept rows only."""
    kept, copies, leader = [], {}, {}
    for i, text in sorted(rows):
        clean = "".join(c for c in text.lower() if c.isalnum() or c.isspace())
        if clean in copies:
            first = copies[clean]
            leader[i] = leader.get(first) if leader.get(first) is not None else first
            continue
        copies[clean] = i
        hits = [k for k, other in kept if jaccard(text, other, size) >= threshold]
        leader[i] = min(hits) if hits else None
        if not hits:
            kept.append((i, text))
    return leader


def test_near_duplicates_equal_greedy_brute_force(spark, messages):
    df = spark.createDataFrame(messages, "id LONG, text STRING")
    got = {r["id"]: r["leader_id"] for r in dedup.near_duplicates(df, "id", "text", bands=64, rows=3).collect()}
    want = greedy(messages)
    assert {i for i, l in got.items() if l is None} == {i for i, l in want.items() if l is None}
    texts = dict(messages)
    for i, l in got.items():
        if l is not None:
            assert want[l] is None and (jaccard(texts[i], texts[l]) >= 0.7 or texts[i] == texts[l])


def test_unrelated_rows_change_no_leader(spark, messages):
    rng = random.Random(5)
    others = [(1000 + i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(8))) for i in range(60)]
    alone, joined = (
        {r["id"]: r["leader_id"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "id LONG, text STRING"), "id", "text", bands=64, rows=3).collect()}
        for rows in (messages[:45], messages[:45] + others)
    )
    assert alone == {i: l for i, l in joined.items() if i < 1000}


def test_clusters_connect_chains(spark, messages):
    df = spark.createDataFrame(messages, "id LONG, text STRING")
    got = {r["id"]: r["cluster_id"] for r in dedup.near_clusters(df, "id", "text", bands=64, rows=3).collect()}
    parent = {i: i for i, _ in messages}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in messages:
        for j, b in messages:
            if j < i and (a == b or jaccard(a, b) >= 0.7):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i, _ in messages}


def test_clusters_keep_chains_of_absorbed_rows_together(spark):
    """Chains in which only neighbours are similar."""
    rng = random.Random(8)
    rows = []
    for chain in range(30):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(24)]
        for link in range(4):
            rows.append((chain * 4 + link, " ".join(words[link * 3 : link * 3 + 15])))
    df = spark.createDataFrame(rows, "id LONG, text STRING")
    got = {r["id"]: r["cluster_id"] for r in dedup.near_clusters(df, "id", "text", threshold=0.6, bands=64, rows=3).collect()}
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.6 for i in range(119) if i % 4 < 3)
    assert got == {i: i // 4 * 4 for i in range(120)}


def test_connected_follows_long_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 201)], "id LONG, other LONG")
    labels = {r["id"]: r["label"] for r in dedup.connected(edges).collect()}
    assert all(labels[i] == 0 for i in range(61)) and labels[201] == labels[200] == 200


def brute_anchors(times, ttl):
    anchors = []
    for at in sorted(times):
        if not anchors or at - anchors[-1] > ttl:
            anchors.append(at)
    return anchors


def test_ttl_anchors(spark):
    rng = random.Random(3)
    hours = {k: [rng.randrange(0, 600) for _ in range(30 if k == "hot" else 4)] for k in ["hot", "a", "b", "c"]}
    hours["chain"] = [0, 40, 50]
    rows = [(k, h) for k, hs in hours.items() for h in hs]
    df = spark.createDataFrame(rows, "key STRING, h INT").select("key", F.timestamp_seconds(F.col("h") * 3600).alias("ts"))
    got = {}
    for r in dedup.ttl_anchors(df, "key", "ts", 48 * 3600).select(
        "key", (F.unix_seconds(F.col("anchor").cast("timestamp")) / 3600).cast("int").alias("h")
    ).collect():
        got.setdefault(r["key"], []).append(r["h"])
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_anchors(v, 48) for k, v in hours.items()}
    assert sorted(got["chain"]) == [0, 50]


def test_codes_stand_for_shingles(spark):
    texts = ["Привет, мир!", "ab", "", "Straße 12 — ok", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", similarity.shingle_codes(3)("t").alias("c")).collect():
        assert len(row["c"]) == len(shingle_set(row["t"]))


def test_semantic_window(spark):
    rows = [(1, "нужен сайт для магазина"), (2, "нужен сайт для магазина!"), (3, "совсем другое сообщение про погоду"),
            (4, "нужен сайт для магазинов")]
    df = spark.createDataFrame(rows, "id LONG, text STRING")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.95, 0.05]), (3, [0.0, 1.0])], "id LONG, v ARRAY<FLOAT>")
    got = {r["id"]: (r["is_duplicate"], r["method"]) for r in
           dedup.semantic_window(df, vectors, "id", "text", "v").collect()}
    assert got[1] == (False, "none") and got[3] == (False, "none")
    assert got[2] == (True, "exact") and got[4] == (True, "semantic")


def test_semantic_window_finds_equal_vectors_of_different_texts(spark):
    df = spark.createDataFrame([(1, "нужен сайт"), (2, "погода завтра"), (3, "совсем другое")], "id LONG, text STRING")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id LONG, v ARRAY<FLOAT>")
    got = {r["id"]: (r["method"], r["score"]) for r in dedup.semantic_window(df, vectors, "id", "text", "v").collect()}
    assert got == {1: ("none", 0.0), 2: ("none", 0.0), 3: ("semantic", 1.0)}


def test_best_match_equals_all_pairs(spark):
    """Planted neighbours of all degrees, copies, and a zero vector."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    near = [base[i % 60] + rng.standard_normal(16) * rng.choice([0.05, 0.3, 0.6, 0.9]) for i in range(150)]
    matrix = np.concatenate([base, near, base[:5], base[:3], np.zeros((1, 16))]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    got = similarity.best_match(spark.createDataFrame(rows, "id LONG, v ARRAY<FLOAT>"), "id", "v", 0.75).collect()
    unit = matrix.astype(np.float64) / np.maximum(np.linalg.norm(matrix.astype(np.float64), axis=1, keepdims=True), 1e-30)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -1)
    want = {i: int(np.argmax(s)) if s.max() > 0.75 else None for i, s in enumerate(sims)}
    assert {r["id"]: r["best_id"] for r in got} == want and sum(v is not None for v in want.values()) > 100
    assert all(r["is_duplicate"] == (r["best_id"] is not None) for r in got)


def test_semantic_window_compares_beyond_the_smallest_row_of_a_bucket(spark):
    """The halves of the first row are swapped: the same shingles, but a low ratio; the third repeats the second."""
    one, two = " ".join(f"alpha{i * 7919}" for i in range(30)), " ".join(f"beta{i * 6271}" for i in range(30))
    rows = [(1, f"{two} {one}"), (2, f"{one} {two}"), (3, f"{one} {two} x"), (4, f"{one} {two} ")]
    df = spark.createDataFrame(rows, "id LONG, text STRING")
    vectors = spark.createDataFrame([(9, [1.0, 0.0])], "id LONG, v ARRAY<FLOAT>")
    got = {r["id"]: r["method"] for r in dedup.semantic_window(df, vectors, "id", "text", "v").collect()}
    assert got == {1: "none", 2: "none", 3: "exact", 4: "exact"}


def test_semantic_window_sees_cosines_of_unlike_texts(spark):
    df = spark.createDataFrame([(1, "нужен сайт для магазина"), (2, "погода завтра"), (3, "нужен сайт для магазина!")], "id LONG, text STRING")
    for angle, method in ((0.7, "none"), (0.5, "exact")):
        vectors = spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0]), (3, [angle, (1 - angle**2) ** 0.5, 0.0])], "id LONG, v ARRAY<DOUBLE>")
        got = {r["id"]: r["method"] for r in dedup.semantic_window(df, vectors, "id", "text", "v").collect()}
        assert got == {1: "none", 2: "none", 3: method}
