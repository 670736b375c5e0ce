"""Hard negatives against plain scoring of all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import hard_negatives as hn
from siftline.llm.queries import SQL, op11

SCHEMA = "vec_id long, label int, embedding array<float>, id string, score int, vector string"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    kept = [(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in sorted({r for r in kept if is_anchor(r[0])}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i)
        for s, j, _ in [r for r in scored if r[2] == l][:positives]:
            found = [(-t, k) for t, k, m in scored if m != l and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, rank + 1, k, -s, t) for rank, (t, k) in enumerate(found)]
    return sorted(out)


def vectors(seed, n=300, dims=8, spread=0.3):
    """Rows around few centres, so that edges are short against norms; float values that a float column holds exactly."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, int(l), [float(c) for c in v]) for i, (l, v) in enumerate(zip(rng.integers(0, 4, n), x))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, tree, wave, block", [(0, 256, 8192, 4096), (1, 3, 7, 16)])
def test_against_all_pairs(spark, monkeypatch, seed, tree, wave, block):
    for name, value in (("TREE", tree), ("WAVE", wave), ("BLOCK", block)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(seed)
    rows += [(1000 + i, l, v) for i, l, v in rows[:120:2]]  # ties
    got = collected(hn.mine(frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (2, 2, [0.75, 0.25]), (3, None, [1.0, 1.0]), (4, 1, None),
        (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (7, 2, [inf, 0.0]), (None, 2, [0.75, 0.25]), (8, 2, []), (9, 2, [0.5]), (10, 1, [-1.0, -1.0]), (11, 2, [0.7, 0.3, 9.0]), (12, 1, []),
    ]
    for anchors in (lambda i: i % 10 == 0, lambda i: i in (8, 9, 12)):
        marked = F.col("vec_id").isin([i for i in range(13) if anchors(i)])
        assert collected(hn.mine(frame(spark, rows), marked)) == brute(rows, anchors)
    assert hn.mine(frame(spark, rows).where("false"), F.lit(True)).collect() == []
    assert hn.mine(frame(spark, rows), F.lit(None).cast("boolean")).collect() == []


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [float(rng.randint(-(2**20), 2**20)) for _ in range(4)]) for i in range(40)]
    assert collected(hn.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, scale=256)) == brute(rows, lambda i: i % 5 == 0)


def test_bounds_hold_and_spare_work():
    """Bounds at every anchor hold the true score; around few centres most candidates are not scored again."""
    rng = np.random.default_rng(5)
    centres = 10 * rng.normal(size=(5, 16))
    points = centres[np.arange(400) % 5] + 0.05 * rng.normal(size=(400, 16))
    anchors = hn.Anchors(range(100), [0] * 100, points[:100].tolist(), 256)
    x = np.floor(256 * points[100:])
    true = anchors.x @ x.T

    def wanted(a, low, high):
        assert (low <= true[a]).all() and (true[a] <= high).all()
        return high >= np.sort(true[a])[-3]

    taken = {}
    computed = hn.visit(anchors, x, wanted, lambda a, rows, scores: taken.__setitem__(a, (rows, scores)))
    assert computed < 0.3 * true.size
    for a, (rows, scores) in taken.items():
        assert (scores == true[a][rows]).all() and set(np.argsort(-true[a])[:2]) <= set(rows.tolist())


def test_tree_is_minimal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, 3))
    _, parent, length = hn.spanning_tree(x)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    joined, total = [{i} for i in range(7)], 0.0  # by shortest edges first
    for d, i, j in sorted((away[i, j], i, j) for i in range(7) for j in range(i)):
        a, b = next(s for s in joined if i in s), next(s for s in joined if j in s)
        if a is not b:
            joined.remove(b)
            a |= b
            total += d
    assert np.isclose(length.sum(), total) and (parent < 0).sum() == 1
    assert len(hn.spanning_tree(np.zeros((0, 3)))[0]) == 0 and hn.spanning_tree(np.zeros((3, 2)))[2].tolist() == [0, 0, 0]


def test_query_and_sql(spark, tmp_path):
    rows = vectors(9, 200)
    rows = [(i, None if i % 41 == 3 else l, None if i % 43 == 5 else v) for i, l, v in rows]
    frame(spark, rows).select("vec_id", "label", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, l if l is None or i % 7 else (l + 1) % 10, v) for i, l, v in rows]
    want = brute(moved, lambda i: i % 50 == 0)
    assert collected(op11(spark, str(tmp_path))) == want and want
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(db.execute(SQL["op11_spanning_tree_negatives"]).fetchall()) == want
