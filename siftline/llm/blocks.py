"""Helpers shared by the operators: reading inputs, Arrow batches in bounded blocks, and words of a block as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most, so that a batch of very long texts fits a worker; a smaller setting of the session stays.
BATCH_ROWS = 1000
#: Text bytes that a task handles at a time; a single longer text is a block of its own.
BLOCK_BYTES = 3_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of every row, a null text as the empty one; other columns are not read."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def blocks(batches: Iterator[pa.RecordBatch], column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BLOCK_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - 1) // BLOCK_BYTES
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keep_blocks(docs: DataFrame, column: str, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text ``keep`` admits; a null text is passed as the empty one."""
    place = docs.columns.index(column)
    bound_batches(docs.sparkSession)

    def run(batches):
        for block in blocks(batches, place):
            texts = [t or "" for t in block.column(place).to_pylist()]
            yield block.filter(pa.array(np.asarray(keep(texts), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def rewrite_blocks(docs: DataFrame, place: int, rewrite: Callable[[list[str]], list[str]]) -> DataFrame:
    """``docs`` with the texts of the column at ``place`` rewritten; nulls stay, all other columns pass as they are."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for block in blocks(batches, place):
            texts = block.column(place).to_pylist()
            made = [None if t is None else m for t, m in zip(texts, rewrite([t or "" for t in texts]))]
            columns = [pa.array(made, pa.string()) if i == place else c for i, c in enumerate(block.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=block.schema.names)

    return docs.mapInArrow(run, docs.schema)


def map_blocks(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``work`` (a block -> columns by name) to every block of ``df``, in Arrow batches."""
    names = [part.split()[0] for part in schema.split(", ")]
    bound_batches(df.sparkSession)

    def run(batches):
        for block in blocks(batches):
            made = work(block)
            yield pa.RecordBatch.from_arrays([pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names], names)

    return df.mapInArrow(run, schema)


_MIX = np.random.default_rng(20_11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


class Words:
    """The white-space separated words of some texts, as arrays over one byte buffer.

    ``start``/``end``: byte spans in ``buffer``; ``doc``: index of the text; ``key``: 64-bit key of the word's bytes;
    ``first``/``count``: the range of words of each text.
    """

    def __init__(self, texts: list[str], table: bytes):
        raw = [t.encode() for t in texts]
        self.buffer = b"\n".join(raw).translate(table) + b"\n"
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
        space = (self.bytes == 32) | ((self.bytes >= 9) & (self.bytes <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.key = self._keys()

    def _keys(self) -> np.ndarray:
        parts = [np.zeros(0, np.uint64)]
        for a, b in pieces(self.end - self.start):
            size = (self.end - self.start)[a:b]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = place + np.repeat(self.start[a:b], size)
            mixed = _MIX[self.bytes[at]] * _POWERS[place & 255]
            parts.append(finish(np.add.reduceat(mixed, np.cumsum(size) - size)))
        return np.concatenate(parts)


def pieces(sizes: np.ndarray, most: int = 500_000) -> list[tuple[int, int]]:
    """Ranges of items whose sizes add up to about ``most``, so that arrays over their parts stay small."""
    if not len(sizes):
        return []
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]))


def finish(key: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys."""
    key = key ^ (key >> np.uint64(29))
    key = key * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))
