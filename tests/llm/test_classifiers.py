"""Toxicity and quality: gradients, solver, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from tests.llm.conftest import ODD

from siftline.llm import labelled, quality, toxicity

INSULTS = ["idiot", "moron", "trash", "loser"]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "ing", "on", "an", "re", "ha", "le", "tion"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(2, 150))]
        toxic = i % 4 == 0
        for _ in range(max(2, len(words) // 30) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        good = i % 3 > 0
        text = " ".join(words) if good else "### ".join(words).upper()
        rows.append((i, text, int(toxic), int(good)))
    return rows


def test_gradients():
    texts = ["an idiot here", "some words there and more of them", "x"]
    inputs, model = toxicity.Inputs(texts), toxicity.Network(1)
    ids, y, weight = inputs.ids(np.arange(3)), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradients(inputs, ids, y, weight)
    rng = np.random.default_rng(0)
    for name, d in g.items():
        d = d.reshape(-1)
        flat = model.p[name].reshape(-1)
        for at in rng.permutation(np.flatnonzero(np.abs(d) > 1e-4))[:4]:
            old, step, losses = flat[at], 2e-2, []
            for change in (step, -step):
                flat[at] = old + change
                losses.append(model.gradients(inputs, ids, y, weight)[0])
            flat[at] = old
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(d[at], rel=0.05, abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        inputs = toxicity.Inputs(["w " * n, "other text"])
        starts, sizes = inputs.at[inputs.doc == 0], inputs.size[inputs.doc == 0]
        assert {i for a, s in zip(starts, sizes) for i in range(a, a + s)} == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:])) and (inputs.doc == 1).sum() == 1


def test_network_does_not_depend_on_the_block():
    texts = [r[1] for r in corpus(30, 5)] + ["", "one"]
    model = {"p": toxicity.Network(2).p, "scale": (1.0, 0.1, 0.0)}
    alone = np.concatenate([toxicity.score_texts(model, [t]) for t in texts])
    assert np.allclose(toxicity.score_texts(model, texts), alone, atol=1e-5)


def held_out_f1(module, label, folds, held):
    rows = corpus(700, 3)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % folds != held]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % folds == held]
    y = np.array([r[label] for r in train])
    model = module.train([r[1] for r in train], y, np.ones(len(y)))
    found = module.score_texts(model, [r[1] for r in test]) >= module.CUT
    truth = np.array([r[label] for r in test]) == 1
    return 2 * (found & truth).sum() / (found.sum() + truth.sum())


def test_held_out_toxicity():
    assert held_out_f1(toxicity, 2, 3, 1) > 0.9


def test_held_out_quality():
    assert held_out_f1(quality, 3, 5, 0) > 0.95


def test_dual_coordinate_descent_reaches_the_optimum(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    y = (x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 * rng.standard_normal(60) > 0).astype(int)
    rows, cost = [np.arange(5)] * 60, np.full(60, 0.5)
    loss = lambda w: 0.5 * (w[:5] @ w[:5] + w[-1] ** 2) + (cost * np.maximum(0, 1 - np.where(y, 1, -1) * (x @ w[:5] + w[-1]))).sum()
    monkeypatch.setattr(quality, "PASSES", 500)
    w = quality.descend(rows, list(x), y, cost)
    best = loss(w)
    for _ in range(300):
        change = np.zeros_like(w)
        change[[0, 1, 2, 3, 4, -1]] = 0.05 * rng.standard_normal(6)
        assert loss(w + change) > best - 1e-2


def test_indicators_are_sets():
    texts = ["a b a b", "", "same same same", "é x", "a b a b"]
    rows = quality.indicator_rows(texts)
    assert all(len(r) == len(set(r.tolist())) for r in rows) and len(rows[1]) == 0
    assert set(rows[0].tolist()) == set(rows[4].tolist())
    alone = [set(quality.indicator_rows([t])[0].tolist()) for t in texts]
    assert [set(r.tolist()) for r in rows] == alone


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(240, 9)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows] + [(i, t, "y") for i, t in ODD if (i or 0) > 1000], "doc_id long, text string, score string")
    labels = [(i, q, t) for i, _, t, q in rows] + [(0, None, None), (None, 1, 1), (4, 0, 1), (99_999, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_queries_over_odd_rows(spark, odd, empty, tables, module):
    docs, labels = tables
    model = module.fit(docs, labels)
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.CUT) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(round(r["score"], 6))
    assert len(by_text[4]) == 1 and by_text[8] == by_text[9] and by_text[1] == by_text[2]
    assert module.score(empty, model).collect() == []
    assert module.score(odd, module.fit(empty, labels)).count() == len(ODD)  # nothing to learn from


def test_sample_keeps_the_held_out_fold_out(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    texts, y, weight = labelled.sample(docs, labels, "toxic", labelled.remainder(F.col("doc_id"), 3) != 1, (20, 10), 10_000)
    held = {t for i, t, _, _ in corpus(240, 9) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert len(texts) == 30 and y.sum() == 10 and not held & set(texts) and weight.min() > 1


def test_drop_toxic(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad and bad
