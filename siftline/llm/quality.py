"""Quality: a naive Bayes support vector machine.

A document is the set of its n-grams (words, pairs of words, and 4-grams of bytes, each hashed to a row), as indicators.
Each indicator is scaled by its class log-count ratio, the scaled vector has length one, and a linear hinge-loss model
over it is fitted by dual coordinate descent.  Runs of one word are n-grams of their own, whatever the word: one for each
length up to LONG_RUN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.blocks import Words, finish, id_and_text, map_blocks
from siftline.llm.labelled import best_threshold, remainder, sample, sigmoid

ROWS, GRAM, LONG_RUN = 1 << 17, 4, 16
PLAIN = bytes(range(256))
#: At most so many labelled documents of each class, none over so many characters, are used for training.
SAMPLE, LONGEST = (2500, 3500), 30_000
ALPHA, COST, PASSES, CUT = 1.0, 1.0, 25, 0.3


def indicator_rows(texts: list[str]) -> list[np.ndarray]:
    """The distinct rows of each text's n-grams, in no particular order."""
    words = Words(texts, PLAIN)
    raw, key = words.bytes, words.key
    code = np.zeros(max(0, len(raw) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        code = code * np.uint64(0x100000001B3) + raw[k : len(raw) - GRAM + 1 + k] + np.uint64(1)
    grams = (finish(code) % np.uint64(ROWS)).astype(np.int32)
    single = (finish(key + np.uint64(5)) % np.uint64(ROWS)).astype(np.int32)
    same = (key[1:] == key[:-1]) & (words.doc[1:] == words.doc[:-1])
    at = np.arange(len(same))
    run = np.minimum(LONG_RUN, at - np.maximum.accumulate(np.where(same, -1, at))) if len(same) else at
    pair = np.where(same, run.astype(np.uint64), key[1:] * np.uint64(0x9E3779B97F4A7C15) + key[:-1] * np.uint64(3))
    pair = (finish(pair) % np.uint64(ROWS)).astype(np.int32)
    offsets = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    place, out = np.empty(ROWS, np.int32), []
    for i in range(len(texts)):
        a, n = words.first[i], words.count[i]
        rows = np.concatenate([single[a : a + n], pair[a : a + max(0, n - 1)], grams[offsets[i] : max(offsets[i], offsets[i + 1] - GRAM)]])
        order = np.arange(len(rows), dtype=np.int32)
        place[rows] = order  # of equal rows, the last one stays
        out.append(rows[place[rows] == order])
    return out


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = [np.full(ROWS, ALPHA), np.full(ROWS, ALPHA)]
    for r, c in zip(rows, y):
        count[int(c)][r] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights of the hinge-loss model (the last one is the bias), one dual variable after the other."""
    sign, w, alpha = np.where(y > 0, 1.0, -1.0), np.zeros(ROWS + 1), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    square = np.array([v @ v for v in values]) + 1.0
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = sign[i] * (w[rows[i]] @ values[i] + w[ROWS]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                moved = max(moved, abs(step))
                alpha[i] = new
                w[rows[i]] += step * values[i]
                w[ROWS] += step
        if moved < 1e-3:
            break
    return w


def _scaled(rows: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    value = ratio[rows]
    return value / max(1e-9, float(np.sqrt(value @ value)))


def margins(model: dict, texts: list[str]) -> np.ndarray:
    ratio, w = model["ratio"], model["w"]
    return np.array([w[r] @ _scaled(r, ratio) + w[ROWS] for r in indicator_rows(texts)]) if texts else np.zeros(0)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> dict:
    """The model and the scale of its score; every fourth text sets the scale only."""
    check = np.arange(len(texts)) % 4 == 3
    if len(set(y[~check])) < 2:
        return {"ratio": np.zeros(ROWS), "w": np.zeros(ROWS + 1), "scale": (0.0, 0.0)}
    rows = [r for at in range(0, len(texts), 200) for r in indicator_rows(texts[at : at + 200])]
    fit = np.flatnonzero(~check)
    ratio = log_count_ratio([rows[i] for i in fit], y[fit])
    values = [_scaled(r, ratio) for r in rows]
    share = np.bincount(y[fit], minlength=2) / len(fit)
    w = descend([rows[i] for i in fit], [values[i] for i in fit], y[fit], COST / (2 * share[y[fit]]))
    margin = np.array([w[r] @ v + w[ROWS] for r, v in zip(rows, values)])[check]
    return {"ratio": ratio.astype(np.float32), "w": w.astype(np.float32), "scale": _scale(margin, y[check], weight[check])}


def _scale(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, moved so that CUT is at the best F1 of the smaller class."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    x, beta = np.stack([margin, np.ones(len(y))], axis=1), np.zeros(2)
    for _ in range(30):
        p = sigmoid(x @ beta)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag([0.1, 0.01])
        beta += np.linalg.solve(curve, x.T @ (weight * (y - p)) - np.array([0.1, 0.01]) * beta)
    cut = -best_threshold(-(x @ beta), 1 - y, weight) if (weight * y).sum() * 2 > weight.sum() else best_threshold(x @ beta, y, weight)
    return float(beta[0]), float(beta[1] - cut + np.log(CUT / (1 - CUT)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sizes=SAMPLE, longest: int = LONGEST) -> dict:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    return train(*sample(docs, labels, "quality", remainder(F.col("doc_id"), folds) != held_out, sizes, longest))


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    a, b = model["scale"]
    return sigmoid(a * margins(model, texts) + b)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text: the chance of good quality, and whether it is CUT or more.

    Null and empty texts have no n-grams and score by the bias alone.  Repeated rows stay; equal texts score equally; an
    empty table gives no rows; other columns are not read.
    """

    def work(block: pa.RecordBatch) -> dict:
        found = score_texts(model, block.column("text").to_pylist())
        return {"doc_id": block.column("doc_id"), "score": pa.array(found, pa.float64()), "predicted": pa.array((found >= CUT).astype(np.int32))}

    return map_blocks(id_and_text(docs, id_col, text_col), work, "doc_id long, score double, predicted int")
