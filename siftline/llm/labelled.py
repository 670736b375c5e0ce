"""Bounded samples of labelled documents, and thresholds, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sizes: tuple[int, int], longest: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and row weights of at most ``sizes[y]`` labelled documents of each class y.

    The documents are the first by a hash of their id among the labelled rows that ``keep`` admits and whose texts have
    at most ``longest`` characters; only these rows reach the driver.  A weight is the number of admitted labels of the
    class for each sampled row, so that weighted rows have the share of the classes in all labels.  Null ids and null
    labels are left out; of repeated labels of a document the largest counts.
    """
    admitted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    short = docs.where(F.length("text") <= longest).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    texts, ys, weights = [], [], []
    for y, size in enumerate(sizes):
        of_class = admitted.where(F.col("y") == y)
        total = of_class.count()
        chosen = of_class.join(short, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select("doc_id")
        rows = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()  # at most ``size`` rows
        got = [r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])]
        texts += got
        ys += [y] * len(got)
        weights += [total / max(1, len(got))] * len(got)
    return texts, np.array(ys, np.int64), np.array(weights)


def best_threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of ``logit`` with the best weighted F1, halfway to the next lower value."""
    order = np.argsort(-logit, kind="stable")
    hit, taken = np.cumsum(weight[order] * y[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (taken + (weight * y).sum())
    ranked = logit[order]
    ends = np.append(ranked[1:] < ranked[:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1
    return float((ranked[best] + below) / 2)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
