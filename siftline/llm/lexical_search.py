"""Ranked lexical search over a sharded inverted index, by Block-Max MaxScore.

Documents are indexed where they lie: some thousand of them form a shard with its own inverted lists.  A list is cut into
blocks of BLOCK postings, stored as gaps and counts of few bytes; each block keeps its first and last document, the
largest count and the shortest document, from which the largest score of the block follows once the statistics of all
documents are known.

A query's terms are ordered by the largest score they give anywhere (the global bounds).  Lists whose bounds together stay below the
lowest score that still enters the result are not essential: they are not walked.  The essential lists give candidates with
partial scores; a candidate is then looked up in the other lists, from the largest bound down, and is dropped as soon as
its score, the bound of the one block that may hold it and the bounds of the lists still to come stay below the entry
score.  Only blocks that survive this are decompressed.  A shard starts with the entry scores of those before it in its task;
tasks give one heap for each query, and heaps are merged in slices, then in whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.blocks import blocks, bound_batches, id_and_text
from siftline.session import cut_lineage

#: Postings of a block; documents and postings that close a shard (a document number fits two bytes).
BLOCK, SHARD_DOCS, SHARD_POSTINGS = 128, 16_384, 4_000_000
#: Bytes of query texts that are searched for at a time; more are searched for in waves over the same index.
WAVE_BYTES = 4_000_000
#: Bytes of a text that are split into terms at a time.
STRETCH = 1_000_000
#: Slices in which heaps are merged first.
SLICES = 32

#: Bytes outside of terms become spaces, A-Z become small.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Columns of a shard, all binary but for the numbers and the list of terms.
_NUMBERS = ("docs", "tokens")
_ARRAYS = {
    "ids": "<i8", "nulls": "u1", "lengths": "<i8", "list_starts": "<i4", "starts": "<i8", "firsts": "<u2", "lasts": "<u2",
    "counts": "u1", "widths": "u1", "places": "<i8", "most": "<i8", "shortest": "<i8", "gaps": "u1", "times": "u1", "far": "<i8", "far_times": "<i8",
}
INDEX = ", ".join([*(f"{n} long" for n in _NUMBERS), "terms array<binary>", *(f"{n} binary" for n in _ARRAYS)])


def terms(raw: bytes) -> Counter:
    """The terms of a text (UTF-8) with their numbers."""
    clean, found, at = raw.translate(_TERMS), Counter(), 0
    while at < len(clean):
        end = len(clean) if len(clean) - at <= STRETCH else clean.find(b" ", at + STRETCH)
        end = len(clean) if end < 0 else end
        found.update(clean[at:end].split())
        at = end
    return found


class _Builder:
    """Collects the documents of a shard."""

    def __init__(self):
        self.vocabulary = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids, self.lengths, self.sizes, self.terms, self.times = [], [], [], [], []

    def add(self, doc_id, raw: bytes) -> None:
        found = terms(raw)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(found.total())
            self.sizes.append(len(found))
            self.terms.extend(map(self.vocabulary.__getitem__, found))
            self.times.extend(found.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def row(self) -> dict:
        """Lists of all terms in the order of the terms' bytes, in blocks."""
        words = sorted(self.vocabulary)
        place = np.empty(len(words), np.int64)
        place[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        lengths = np.array(self.lengths, np.int64)
        term, times = place[np.array(self.terms, np.int64)], np.array(self.times, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(term, kind="stable")  # documents of a term stay in order
        term, doc, times = term[order], doc[order], times[order]
        sizes = np.bincount(term, minlength=len(words))
        per_list = -(-sizes // BLOCK)
        list_starts = np.concatenate(([0], np.cumsum(per_list)))
        number = np.arange(list_starts[-1]) - np.repeat(list_starts[:-1], per_list)
        starts = np.repeat(np.cumsum(sizes) - sizes, per_list) + number * BLOCK
        counts = np.diff(np.append(starts, len(doc)))
        firsts, lasts = doc[starts], doc[starts + counts - 1]
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0
        widths = 1 + (np.maximum.reduceat(gaps, starts) > 255)
        places = np.cumsum(widths * counts) - widths * counts
        width = np.repeat(widths, counts)
        at = np.repeat(places, counts) + (np.arange(len(doc)) - np.repeat(starts, counts)) * width
        packed = np.zeros(int((widths * counts).sum()), np.uint8)
        packed[at] = gaps & 255
        packed[at[width == 2] + 1] = gaps[width == 2] >> 8
        far = np.flatnonzero(times > 255)
        made = {
            "ids": [0 if i is None else i for i in self.ids], "nulls": [i is None for i in self.ids], "lengths": lengths, "list_starts": list_starts, "starts": starts,
            "firsts": firsts, "lasts": lasts, "counts": counts, "widths": widths, "places": places, "most": np.maximum.reduceat(times, starts),
            "shortest": np.minimum.reduceat(lengths[doc], starts), "gaps": packed, "times": np.minimum(times, 255), "far": far, "far_times": times[far],
        }
        row = {n: np.asarray(made[n]).astype(t).tobytes() for n, t in _ARRAYS.items()}
        return row | {"docs": len(self.ids), "tokens": int(lengths.sum()), "terms": words}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([*((n, pa.int64()) for n in _NUMBERS), ("terms", pa.list_(pa.binary())), *((n, pa.binary()) for n in _ARRAYS)])
    return pa.RecordBatch.from_pylist(rows, schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each shard: its documents with terms, and the inverted lists of all their terms."""
    bound_batches(docs.sparkSession)

    def run(batches):
        shard = _Builder()
        for block in blocks(batches):
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text")):
                shard.add(doc_id, text.as_buffer().to_pybytes())
                if shard.full():
                    yield _batch([shard.row()])
                    shard = _Builder()
        if shard.ids:
            yield _batch([shard.row()])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, INDEX)


class Shard:
    """A shard's arrays; lists that were decompressed in whole are kept until the next shard."""

    def __init__(self, batch: pa.RecordBatch, row: int, n: int, total: int):
        for name, kind in _ARRAYS.items():
            setattr(self, name, np.frombuffer(batch.column(name)[row].as_buffer(), kind))
        self.words = batch.column("terms")[row].values
        self.m = _m(self.lengths, n, total)
        self.bounds = _gain(self.most, _m(self.shortest, n, total))
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def lists(self, vocabulary: pa.Array) -> np.ndarray:
        """Number of the list of each word of the vocabulary, -1 without one."""
        return np.asarray(pc.fill_null(pc.index_in(vocabulary, value_set=self.words), -1))

    def size(self, number: int) -> int:
        return int(self.counts[self.list_starts[number] : self.list_starts[number + 1]].sum(dtype=np.int64))

    def bound(self, number: int) -> int:
        return int(self.bounds[self.list_starts[number] : self.list_starts[number + 1]].max())

    def open(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of the postings of some blocks, which are decompressed."""
        self.opened += len(chosen)
        counts = self.counts[chosen].astype(np.int64)
        ends = np.cumsum(counts)
        inner = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        width = np.repeat(self.widths[chosen].astype(np.int64), counts)
        at = np.repeat(self.places[chosen], counts) + inner * width
        gaps = self.gaps[at].astype(np.int64)
        wide = np.flatnonzero(width == 2)
        gaps[wide] += self.gaps[at[wide] + 1].astype(np.int64) << 8
        run = np.cumsum(gaps)
        docs = run - np.repeat(run[ends - counts], counts) + np.repeat(self.firsts[chosen].astype(np.int64), counts)
        posting = np.repeat(self.starts[chosen], counts) + inner
        times = self.times[posting].astype(np.int64)
        full = np.flatnonzero(times == 255)
        if len(full) and len(self.far):
            place = np.minimum(np.searchsorted(self.far, posting[full]), len(self.far) - 1)
            times[full] = np.where(self.far[place] == posting[full], self.far_times[place], 255)
        return docs, _gain(times, self.m[docs])

    def all_of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number not in self.whole:
            self.whole[number] = self.open(np.arange(self.list_starts[number], self.list_starts[number + 1]))
        return self.whole[number]


def _m(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 100 - 25 + (25 * lengths * n) // total


def _gain(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Heap:
    """The best documents of a query so far: scores downwards, then ids upwards, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)

    @property
    def entry(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def push(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        score, null, ids = (np.concatenate(p) for p in ((self.score, score), (self.null, null), (self.ids, ids)))
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.ids = score[best], null[best], ids[best]


def search_shard(shard: Shard, found: list[tuple[int, int, int]], heap: Heap) -> None:
    """Enter the shard's best documents for one query; ``found``: (list, weight, global bound of a posting's gain) of its terms."""
    found = sorted(found, key=lambda f: f[1] * f[2])
    ahead = np.cumsum([0] + [w * b for _, w, b in found])
    entry = heap.entry
    essential = int(np.searchsorted(ahead[1:], entry, "left"))  # lists before it cannot reach the entry score together
    if essential == len(found):
        return
    scores = np.zeros(len(shard.ids), np.int64)
    for number, w, _ in found[essential:]:
        docs, gains = shard.all_of(number)
        scores[docs] += w * gains
    docs = np.flatnonzero(scores)
    for i in range(essential, -1, -1):
        if len(docs) >= heap.k:  # as many documents score at least this
            entry = max(entry, int(np.partition(scores[docs], -heap.k)[-heap.k]))
        docs = docs[scores[docs] + ahead[i] >= entry]
        if i == 0 or not len(docs):
            break
        number, w, _ = found[i - 1]
        begin, end = shard.list_starts[number], shard.list_starts[number + 1]
        block = begin + np.searchsorted(shard.firsts[begin:end], docs, "right") - 1
        inside = (block >= begin) & (docs <= shard.lasts[block])
        best = np.where(inside, w * shard.bounds[block], 0)
        alive = scores[docs] + best + ahead[i - 1] >= entry
        docs, block, inside = docs[alive], block[alive], inside[alive]
        if inside.any():
            at, gains = shard.whole[number] if number in shard.whole else shard.open(np.unique(block[inside]))
            place = np.minimum(np.searchsorted(at, docs), len(at) - 1)
            hit = at[place] == docs
            scores[docs[hit]] += w * gains[place[hit]]
    if len(docs):
        heap.push(scores[docs], shard.nulls[docs], shard.ids[docs])


def _queries(items: list, words: dict[bytes, int]) -> list[list[tuple[int, int]]]:
    return [[(words[t], n) for t, n in terms(text.encode()).items()] for _, text in items]


def _wave(index: DataFrame, items: list, n: int, total: int, k: int, kind: str) -> DataFrame:
    """The results of some queries, whose texts and terms travel with the tasks."""
    words = sorted({t for _, text in items for t in terms(text.encode())})
    asked = _queries(items, {t: i for i, t in enumerate(words)})
    vocabulary = pa.array(words, pa.binary())
    names = [i for i, _ in items]

    def statistics(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row, n, total)
                lists = shard.lists(vocabulary)
                held = np.flatnonzero(lists >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), pa.array([shard.size(i) for i in lists[held]], pa.int64()), pa.array([shard.bound(i) for i in lists[held]], pa.int64())], ["term", "df", "bound"]
                )

    known = index.mapInArrow(statistics, "term long, df long, bound long").groupBy("term").agg(F.sum("df").alias("df"), F.max("bound").alias("bound")).collect()
    weights = {r["term"]: (weight(n, r["df"]), r["bound"]) for r in known}

    def run(batches):
        heaps = [Heap(k) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row, n, total)
                lists = shard.lists(vocabulary).tolist()
                for query, heap in zip(asked, heaps):
                    found = [(lists[t], times * weights[t][0], weights[t][1]) for t, times in query if lists[t] >= 0]
                    search_shard(shard, found, heap)
        part = TaskContext.get().partitionId()
        for number, heap in enumerate(heaps):
            if len(heap.score):
                size = len(heap.score)
                columns = [np.full(size, number), np.full(size, part % SLICES), heap.score]
                ids = pa.array(heap.ids, mask=heap.null.astype(bool))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, pa.array([names[number]] * size, pa.string())], ["query", "slice", "score", "doc_id", "item_id"])

    heaps = index.mapInArrow(run, "query long, slice long, score long, doc_id long, item_id string")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("query", "slice").orderBy(*best))).where(F.col("rank") <= k)
    merged = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k)
    return merged.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def search_index(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of a built (and kept) index for each item, as ``search``."""
    kind = items.schema[item_col].dataType.simpleString()
    empty = items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    n, total = index.agg(F.sum("docs"), F.sum("tokens")).first()
    asked = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("t") + 100)).first()[0]
    if not n or not size:
        return empty
    waves = -(-size // WAVE_BYTES)
    made = None
    for wave in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(waves)) == wave).collect()
        if rows:
            found = _wave(index, [(r["i"], r["t"]) for r in rows], n, total, k, kind)
            found = found if waves == 1 else cut_lineage(found)
            made = found if made is None else made.union(found)
    return empty if made is None else made


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of all documents for each item.

    Scores are sums of integer term weights with saturation and length normalisation; equal scores come by ascending
    id, null ids last.  Null and empty texts have no terms: such documents are not counted and never found, such items
    have no rows, nor have items whose terms no document holds.  Repeated documents are documents of their own; items
    equal in id and text are one query, items equal in id only are ranked each.  Empty tables give no rows.  Other
    columns are not read.  The index is checkpointed once; query texts reach the driver, at most about WAVE_BYTES of
    them at a time, whatever the number of items.
    """
    return search_index(cut_lineage(build_index(docs, id_col, text_col)), items, k, item_col, text_col)
