"""Packing by concatenation and cutting: token streams of all documents form one line, which is cut into equal windows.

The first pass encodes every document once and notes, for each partition, where its documents begin in the partition's own
stream.  Prefix sums over the partitions' totals, taken in two levels, give each partition its place in the line.  The
second pass cuts every document at the borders of the windows that lie in it.  Only the last window can be short, so at
most one window is padded, however many documents there are.

Windows that lie within one partition are complete there.  A window that reaches over the border of partitions is left
in boundary records, one for each side, and only these are shuffled to be joined.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.blocks import blocks, bound_batches, id_and_text
from siftline.session import cut_lineage

#: Ids of a sequence, and the id that ends a document.
SEQUENCE, END = 1024, 0
#: Characters encoded at a time; longer texts are cut where a word is followed by white space, which no token spans.
STRETCH = 100_000
#: Partitions up to which their places travel with the tasks (16 bytes each); beyond, they are joined.
FEW_PARTS = 200_000
#: Partitions whose totals are summed together in the lower level of the prefix sums.
GROUP = 1024

#: White space as tokenizers know it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BORDER = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_WITHIN = re.compile(f"[{_SPACE}]+[^{_SPACE}]+\\Z")
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Encoded chunks that a Python worker keeps; beyond it the later half is forgotten, which costs time only.
KEPT = 1_000_000
CODED = "part long, before long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_file(path: str | None = None) -> bytes:
    """The tokenizer's bytes, by default of the public byte-level vocabulary, read once on the driver and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _tokenizer(payload: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_buffer(payload)
    made.no_truncation()
    made.no_padding()
    names = made.get_vocab(with_added_tokens=True)
    special = made.get_added_tokens_decoder()
    sizes = np.zeros(max(names.values(), default=0) + 1, np.int64)
    for name, number in names.items():  # a letter stands for a byte
        sizes[number] = len(name.encode()) if number in special else len(name)
    return made, sizes, {}


def stretches(text: str) -> list[str]:
    """The text in parts of about STRETCH characters whose encodings, put together, are that of the text."""
    cuts, at = [0], 0
    while len(text) - at > STRETCH:
        found = _BORDER.search(text, at + STRETCH)
        if found is None:
            break
        at = found.start()
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _learn(tokenizer, sizes: np.ndarray, known: dict[str, bytes], chunks: list[str]) -> None:
    """Encode chunks.  Those between white space and other characters are encoded as one text, which costs less, and told
    apart by the bytes of their tokens."""
    joined = [c for c in chunks if _WITHIN.match(c)]
    ids = array("I", tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids)
    ends = np.cumsum(sizes[np.frombuffer(ids, np.uint32)]) if ids else np.zeros(0, np.int64)
    cuts = (np.searchsorted(ends, np.cumsum([len(c.encode()) for c in joined]), "right") * 4).tolist() if joined else []
    raw = ids.tobytes()
    known.update(zip(joined, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
    rest = [c for c in chunks if not _WITHIN.match(c)]
    known.update(zip(rest, (array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False))))


def encoded(payload: bytes, texts: list[str]) -> list[bytes]:
    """Token ids of the texts, each followed by END, as little-endian unsigned 32-bit numbers.

    White space and what follows it up to the next white space is encoded once by the library, then looked up.
    """
    tokenizer, sizes, known = _tokenizer(payload)
    made: list[list[bytes]] = [[] for _ in texts]
    waiting, size = [], 0

    def flush():
        words = set().union(*(chunks for _, chunks in waiting))
        new = list(words.difference(known))
        if len(known) + len(new) > KEPT:  # those met first are the frequent ones
            for chunk in list(known)[KEPT // 2 :]:
                del known[chunk]
            new = list(words.difference(known))
        for at in range(0, len(new), 10_000):
            _learn(tokenizer, sizes, known, new[at : at + 10_000])
        for number, chunks in waiting:
            made[number].append(b"".join(map(known.__getitem__, chunks)))

    for number, text in enumerate(texts):
        for stretch in stretches(text):
            waiting.append((number, _CHUNK.findall(stretch)))
            size += len(stretch)
            if size > 10 * STRETCH:
                flush()
                waiting, size = [], 0
    flush()
    return [b"".join([*parts, END.to_bytes(4, "little")]) for parts in made]


def coded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, before, doc_id, doc_tokens, ids)``: the ids of every document with its partition and the ids before it there."""
    payload = tokenizer_file(path)
    bound_batches(docs.sparkSession)

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for block in blocks(batches):
            made = encoded(payload, block.column("text").to_pylist())
            sizes = np.array([len(m) // 4 for m in made], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            columns = [pa.array(np.full(len(made), part, np.int64)), pa.array(starts), block.column("doc_id"), pa.array(sizes), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "before", "doc_id", "doc_tokens", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, CODED)


def places(totals: DataFrame) -> DataFrame:
    """``(part, base)`` from ``(part, total)``: the sum of the totals of all smaller parts, by groups of parts and within them."""
    grouped = totals.withColumn("group", F.floor(F.col("part") / GROUP))
    sums = grouped.groupBy("group").agg(F.sum("total").alias("all"))
    over = sums.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("ahead"))
    within = F.sum("total").over(Window.partitionBy("group").orderBy("part")) - F.col("total")
    return grouped.withColumn("within", within).join(over, "group").select("part", (F.col("ahead") + F.col("within")).alias("base"))


def _cut(block: pa.RecordBatch, sequence: int) -> pa.RecordBatch:
    """Pieces of the documents of a block, between the borders of the windows."""
    first = np.asarray(block.column("base"), np.int64) + np.asarray(block.column("before"), np.int64)
    size = np.asarray(block.column("doc_tokens"), np.int64)
    windows = (first + size - 1) // sequence - first // sequence + 1
    row = np.repeat(np.arange(len(size)), windows)
    number = first[row] // sequence + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.maximum(number * sequence, first[row])
    end = np.minimum((number + 1) * sequence, first[row] + size[row])
    ids = [v.as_buffer() for v in block.column("ids")]
    start = begin - first[row]
    cut = [bytes(memoryview(ids[r])[4 * s : 4 * (s + n)]) for r, s, n in zip(row.tolist(), start.tolist(), (end - begin).tolist())]
    columns = [block.column("doc_id").take(pa.array(row)), *map(pa.array, (start, end - begin, size[row], number, begin - number * sequence)), pa.array(cut, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pieces(docs: DataFrame, path: str | None = None, *, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of every piece of a document; ``ids`` are
    little-endian unsigned 32-bit numbers, the last one of a document is END.

    A null or empty text is one piece with the id END alone.  Repeated rows are packed one by one, null ids are kept, an empty table gives no
    rows, and other columns, whatever their names, are not read.  All sequences but the last are full.  Which documents
    lie together follows from the partitions of ``docs``.
    """
    found = cut_lineage(coded(docs, path, id_col, text_col))
    bases = places(found.groupBy("part").agg(F.sum("doc_tokens").alias("total")))
    if found.rdd.getNumPartitions() <= FEW_PARTS:
        bases = F.broadcast(bases)

    def run(batches):
        for block in blocks(batches, "ids"):
            yield _cut(block, sequence)

    return found.join(bases, "part").select("doc_id", "before", "base", "doc_tokens", "ids").mapInArrow(run, PIECES)


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"]))


def sequences(packed: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``sequence_id, n_tokens, ids, documents`` of every sequence of ``pieces``: its ids, padded with END to the full
    length unless ``n_tokens`` is a power of two, and the ``(doc_id, start, length, offset)`` of its documents in order.

    Sequences that a batch holds in whole are made there; of the others, one record for each batch is shuffled and joined.
    """
    fields = "array<struct<offset:bigint,doc_id:bigint,start:bigint,length:bigint>>"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            number = np.asarray(batch.column("sequence_id"))
            cuts = np.flatnonzero(np.diff(number)) + 1
            ids = batch.column("ids").to_pylist()
            rows = batch.select(["offset", "doc_id", "start", "length"]).to_pylist()
            spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(number[a]) for a, _ in spans], pa.int64()),
                    pa.array([[{"offset": rows[i]["offset"], "ids": ids[i]} for i in range(a, b)] if sum(len(x) for x in ids[a:b]) < 4 * sequence else None for a, b in spans], pa.list_(pa.struct([("offset", pa.int64()), ("ids", pa.binary())]))),
                    pa.array([b"".join(ids[a:b]) for a, b in spans], pa.binary()),
                    pa.array([rows[a:b] for a, b in spans], pa.list_(pa.struct([(n, pa.int64()) for n in ("offset", "doc_id", "start", "length")]))),
                ],
                ["sequence_id", "parts", "whole", "documents"],
            )

    made = packed.mapInArrow(run, f"sequence_id long, parts array<struct<offset:bigint,ids:binary>>, whole binary, documents {fields}")
    full = made.where("parts is null").select("sequence_id", "whole", "documents")
    edges = made.where("parts is not null").groupBy("sequence_id").agg(
        F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"), F.array_sort(F.flatten(F.collect_list("documents"))).alias("documents")
    )
    every = full.union(edges.select("sequence_id", _joined(F.col("parts")).alias("whole"), "documents"))
    n = (F.length("whole") / 4).cast("long")
    padded = F.when(n.bitwiseAND(n - 1) == 0, F.col("whole")).otherwise(F.rpad("whole", 4 * sequence, F.lit(END.to_bytes(1, "little"))))
    return every.select("sequence_id", n.alias("n_tokens"), padded.alias("ids"), "documents")
