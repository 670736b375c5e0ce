"""Hard negatives by spanning-tree bounds between anchors.

Anchors that travel together form minimum spanning trees by their distances.  A block of candidates is scored exactly at
the root of a tree; down an edge of length d the score of a candidate of norm n moves by d * n at most, so its parent's
bounds, plus and minus d * n, bound the score at the child.  A candidate is rescored at an anchor only if these bounds
overlap a window in which it could still enter the result there; its score then is its bound for the children.

Scores are integers: components are scaled and floored, and inner products are exact.  There are two passes over all
rows, for the anchors' positives and, with the windows of their scores, for the negatives.  Only anchors travel, a bounded
number at a time; candidates stay where they are, and each task gives the best few of its rows for each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.blocks import bound_batches
from siftline.session import cut_lineage

#: Anchors of a tree, and anchors that travel with the tasks at a time.
TREE, WAVE = 256, 8192
#: Candidates that are scored at a time.
BLOCK = 4096
#: Slices in which the tasks' best rows are merged first.
SLICES = 32
#: Inner products below this are exact as doubles, in any order of summation.
EXACT = 2.0**53


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): a minimum spanning tree over the rows of ``x``, parents first; the root's parent is -1."""
    n = len(x)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, way, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = 0
    for step in range(n):
        order[step], parent[at], length[at] = at, way[at], 0 if way[at] < 0 else near[at]
        out[at] = False
        away = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = out & (away < near)
        near[closer], way[closer] = away[closer], at
        if step + 1 < n:
            at = int(np.argmin(np.where(out, near, np.inf)))
    return order, parent, length


class Anchors:
    """Some anchors in the order of label and id, with their trees."""

    def __init__(self, ids, labels, vectors: list[list[float]], scale: int):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.width = max((len(v) for v in vectors), default=0)
        self.x = np.zeros((len(vectors), self.width))
        for row, v in zip(self.x, vectors):
            row[: len(v)] = np.floor(scale * np.array(v, np.float64))
        self.norm = float(np.sqrt((self.x**2).sum(axis=1)).max(initial=0))
        self.trees = [(a, *spanning_tree(self.x[a : a + TREE])) for a in range(0, len(vectors), TREE)]


def matrix(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Scaled and floored components, shorter vectors filled up by zeros and longer ones cut, as anchors have no more."""
    flat = np.asarray(vectors.flatten(), np.float64)
    sizes = np.diff(np.asarray(vectors.offsets))
    if len(sizes) and (sizes == width).all():
        return np.floor(scale * flat.reshape(-1, width))
    made = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    made[row[place < width], place[place < width]] = np.floor(scale * flat[place < width])
    return made


class Best:
    """The first rows of a list: scores downwards, then ids upwards."""

    __slots__ = ("k", "score", "ids")

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def entry(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
        first = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[first], ids[first]


def visit(anchors: Anchors, x: np.ndarray, wanted, take) -> int:
    """Walk the trees over the candidates ``x``: ``wanted(anchor, low, high)`` marks candidates to be scored given their
    bounds, ``take(anchor, rows, scores)`` gets the exact scores of these.  Returns how many scores were computed."""
    norms = np.sqrt((x**2).sum(axis=1))
    exact = anchors.norm * float(norms.max(initial=0)) < EXACT
    whole = None if exact else x.astype(np.int64)
    computed = 0
    for begin, order, parent, length in anchors.trees:
        low, high = np.empty((len(order), len(x))), np.empty((len(order), len(x)))
        for i in order.tolist():
            anchor, root = begin + i, parent[i] < 0
            if root:
                low[i], high[i] = -np.inf, np.inf
                rows = np.arange(len(x))
            else:
                reach = length[i] * norms * (1 + 1e-12) + 1e-6 * (1 + norms)
                np.subtract(low[parent[i]], reach, out=low[i])
                np.add(high[parent[i]], reach, out=high[i])
            mine = wanted(anchor, low[i], high[i])
            if not root:
                rows = np.flatnonzero(mine)
            if not len(rows):
                continue
            if exact:
                scores = (x[rows] if 2 * len(rows) < len(x) else x) @ anchors.x[anchor]
                scores = scores if 2 * len(rows) < len(x) else scores[rows]
            else:
                scores = whole[rows] @ anchors.x[anchor].astype(np.int64)
            computed += len(rows)
            low[i, rows] = high[i, rows] = scores
            keep = mine[rows]
            take(anchor, rows[keep], scores[keep].astype(np.int64))
    return computed


def first_positives(anchors: Anchors, best: list[Best], ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
    """Enter the candidates of an anchor's label, but the anchor itself."""

    def wanted(a, low, high):
        return (labels == anchors.labels[a]) & (ids != anchors.ids[a]) & (high >= best[a].entry)

    def take(a, rows, scores):
        near = scores >= best[a].entry
        if near.any():
            best[a].push(scores[near], ids[rows[near]])

    return visit(anchors, x, wanted, take)


def first_negatives(anchors: Anchors, windows: list[list[tuple[int, int]]], best: list[list[Best]], ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
    """Enter the candidates of other labels whose scores lie in a window ``(least, most)`` of the anchor."""

    def wanted(a, low, high):
        other = labels != anchors.labels[a]
        overlap = np.zeros(len(other), bool)
        for (least, most), b in zip(windows[a], best[a]):
            if least <= most:
                overlap |= (low <= most) & (high >= max(least, b.entry))
        return other & overlap

    def take(a, rows, scores):
        for (least, most), b in zip(windows[a], best[a]):
            near = (scores >= max(least, b.entry)) & (scores <= most)
            if near.any():
                b.push(scores[near], ids[rows[near]])

    return visit(anchors, x, wanted, take)


def _blocks(batches, width: int, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield np.asarray(part.column("id")), np.asarray(part.column("label")), matrix(part.column("vector"), width, scale)


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key: of its slices first, so that no task gets all rows of a key."""
    best = [F.desc("score"), F.asc("id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*best))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)


def _wave(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    count = len(anchors.ids)

    def near(batches):
        best = [Best(positives) for _ in range(count)]
        for ids, labels, x in _blocks(batches, anchors.width, scale):
            first_positives(anchors, best, ids, labels, x)
        part = TaskContext.get().partitionId() % SLICES
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            number = np.repeat(np.arange(count), sizes)
            columns = [number, np.full(len(number), part), np.concatenate([b.score for b in best]), np.concatenate([b.ids for b in best])]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["anchor", "slice", "score", "id"])

    found = _merged(rows.mapInArrow(near, "anchor long, slice long, score long, id long"), ["anchor"], positives)
    known: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    for r in sorted(found.select("anchor", "rank", "id", "score").collect()):
        known[r["anchor"]].append((r["id"], r["score"]))
    windows = [[(-(-low * s // 100), high * s // 100) for _, s in mine] for mine in known]

    def far(batches):
        best = [[Best(negatives) for _ in mine] for mine in windows]
        for ids, labels, x in _blocks(batches, anchors.width, scale):
            first_negatives(anchors, windows, best, ids, labels, x)
        part = TaskContext.get().partitionId() % SLICES
        made = [(a, p, b) for a, mine in enumerate(best) for p, b in enumerate(mine) if len(b.ids)]
        if made:
            sizes = [len(b.ids) for _, _, b in made]
            spread = lambda values: np.repeat(np.array(values, np.int64), sizes)
            columns = [
                spread([a for a, _, _ in made]), spread([p for _, p, _ in made]), np.full(sum(sizes), part), np.concatenate([b.score for _, _, b in made]),
                np.concatenate([b.ids for _, _, b in made]), spread([anchors.ids[a] for a, _, _ in made]), spread([known[a][p][0] for a, p, _ in made]), spread([known[a][p][1] for a, p, _ in made]),
            ]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["anchor", "place", "slice", "score", "id", "anchor_id", "positive_id", "positive_score"])

    schema = "anchor long, place long, slice long, score long, id long, anchor_id long, positive_id long, positive_score long"
    merged = _merged(rows.mapInArrow(far, schema), ["anchor", "place"], negatives)
    return merged.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for the rows that ``anchor`` marks, and
    for each of their ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's.

    A score is the inner product with the anchor of components ``floor(scale * x)``; equal scores come by ascending id.
    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part.  A row is not
    compared with rows of its own id.  Of vectors of unequal length, missing components count as zero.  Repeated rows are candidates
    of their own; anchors equal in id, label and vector are one.  Scores must fit 64 bits.  A positive whose score is
    negative has an empty window.  Empty tables give no rows; other columns, whatever their names, are not read.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), "_anchor"
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.coalesce(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
    chosen = rows.where("_anchor").groupBy("id", "label", F.xxhash64("vector").alias("key")).agg(F.first("vector").alias("vector"))
    waves = -(-chosen.count() // WAVE)
    rows = rows.select("id", "label", "vector")
    made = None
    for wave in range(waves):
        part = sorted(chosen.where(F.pmod(F.xxhash64("id", "key"), F.lit(waves)) == wave).collect(), key=lambda r: (r["label"], r["id"], r["key"]))
        if part:
            anchors = Anchors([r["id"] for r in part], [r["label"] for r in part], [r["vector"] for r in part], scale)
            found = _wave(rows, anchors, positives, negatives, low, high, scale)
            found = found if waves == 1 else cut_lineage(found)
            made = found if made is None else made.union(found)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return made
