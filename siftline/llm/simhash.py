"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through pigeonring chains of segments.

The bits form a ring of three segments.  If two fingerprints differ in at most TAU = 2 bits, some segment starts a
chain in which the first k segments differ in at most k * TAU / 3 bits together, for every k: 0, then 1, then 2.  So
candidates share a segment, must then pass the budget of the next one, and only then are compared as a whole.

Texts of a given Jaccard similarity can differ in many more bits (at 0.8 mostly in 3 to 10), for which no segment is
selective.  Where a similarity is asked for, such texts are found through MinHash bands and compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import similarity
from siftline.llm.blocks import finish, id_and_text, map_blocks
from siftline.llm.components import components
from siftline.operators import neighbours
from siftline.session import cut_lineage

SHINGLE, SEED, TAU = 3, 42, 2
#: (lowest bit, bits) of the segments, in ring order.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Segment values shared by more distinct fingerprints than this are linked through pivots instead of comparisons.
BUCKET = 64
#: Links by similarity: words of a shingle, and MinHash bands of so many rows.  A pair at 0.8 shares no band with a chance of 3e-6.
WORDS, BANDS, ROWS = 5, 32, 5


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # bit counts of so many fit a byte
        bits = np.unpackbits(hashes[at : at + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    bits = np.flatnonzero(2 * counts > len(hashes))
    return int(sum(1 << int(b) for b in bits))


def shingle_codes(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles (of the whole text if it is shorter); words as in fingerprints."""
    words = text.encode().lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    codes = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        codes = finish(codes * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return np.unique(codes.view(np.int64))


def _signature(codes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Band keys, one bit of each MinHash row packed into 64-bit numbers, and the number of codes; empty without codes."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lows = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 512):
        hashed = codes.view(np.uint64)[at : at + 512, None] * odd + add
        hashed ^= hashed >> np.uint64(32)
        lows = np.minimum(lows, hashed.min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in lows.reshape(BANDS, ROWS).T:
        keys = finish(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    bits = np.zeros(-(-len(lows) // 64) * 64, np.uint8)
    bits[: len(lows)] = finish(lows) & np.uint64(1)
    return keys.view(np.int64), np.packbits(bits, bitorder="little").view("<i8"), len(codes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: bool = False) -> DataFrame:
    """``(doc_id, text_key, fp)``: the fingerprint of every whole text as a signed 64-bit number, 0 for texts without
    words, and a hash of the text that tells rows of equal id apart.  With ``bands``, also its MinHash band keys, one bit
    of each MinHash row, and the number of its shingles."""
    family = similarity._hash_family(BANDS * ROWS)

    def work(block: pa.RecordBatch) -> dict:
        texts = block.column("text").to_pylist()
        found = np.array([fingerprint(t) for t in texts], np.uint64)
        made = {"doc_id": block.column("doc_id"), "text_key": block.column("text_key"), "fp": pa.array(found.view(np.int64))}
        if bands:
            signed = [_signature(shingle_codes(t), *family) for t in texts]
            made["bands"] = pa.array([s[0] for s in signed], pa.list_(pa.int64()))
            made["bits"] = pa.array([s[1] for s in signed], pa.list_(pa.int64()))
            made["size"] = pa.array([s[2] for s in signed], pa.int64())
        return made

    keyed = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return map_blocks(keyed, work, "doc_id long, text_key long, fp long" + (", bands array<long>, bits array<long>, size long" if bands else ""))


def segment(fp: Column, i: int) -> Column:
    low, size = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` exactly as all pairs within TAU bits would.

    Fingerprints that share a segment value with at most BUCKET others are compared along the chain.  Where more share
    it, each is sent to the 65 values within one bit of it: two fingerprints are within two bits exactly if they have
    such a value in common, no value gets more than 65 of them, and each is tied to the least one.
    """
    rows = fps.select(
        "fp", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), segment(F.col("fp"), i).alias("key"), segment(F.col("fp"), i + 1).alias("next")) for i in range(3)]))
    )
    sizes = rows.groupBy("i", "key").agg(F.count("*").alias("n"))
    shared = cut_lineage(rows.join(sizes.where("n > 1"), ["i", "key"]))
    few = shared.where(F.col("n") <= BUCKET)
    a, b = few.alias("a"), few.alias("b")
    differ = lambda column: F.bit_count(F.col(f"a.{column}").bitwiseXOR(F.col(f"b.{column}")))
    compared = a.join(
        b,
        (F.col("a.i") == F.col("b.i"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (differ("next") <= 2 * TAU // len(SEGMENTS))
        & (differ("fp") <= TAU),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(64)])
    pivots = many.select("fp", F.explode(near).alias("pivot"))
    tied = pivots.groupBy("pivot").agg(F.min("fp").alias("low"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return compared.union(tied.select(F.col("low").alias("a"), F.explode("all").alias("b")).where("a <> b"))


def similar_links(docs: DataFrame, marked: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges ``(a, b)`` that connect the fingerprints of the texts of a similarity of ``least``.

    Texts meet in MinHash bands: first each with the least of its band, which joins groups of copies by one comparison a
    member, then those of small bands that are still apart.  Large bands, such as those of texts with a common passage, are
    split by further bands: a pair at 0.8 shares another one with a chance of 1/3 and stays together in one of three
    ways on average, while texts of less similarity fall apart.  All pairs are compared exactly.
    """
    texts = cut_lineage(
        marked.groupBy("text_key").agg(
            F.first("fp").alias("fp"), F.min("doc_id").alias("low"), F.first("bands").alias("keys"), F.first("bits").alias("bits"), F.first("size").alias("size")
        )
    )
    rows = texts.select(F.col("text_key").alias("id"), "keys", F.size("keys").alias("first"), "size", "bits", F.lit(None).cast("long").alias("time"), F.lit(True).alias("accepted"))

    def work(block: pa.RecordBatch) -> dict:
        made = [shingle_codes(t) for t in block.column("text").to_pylist()]
        return {"id": block.column("id"), "codes": pa.array(made, pa.list_(pa.int64()))}

    def codes_of(ids: DataFrame) -> DataFrame:
        wanted = neighbours.small(cut_lineage(texts.join(ids, texts["text_key"] == ids["id"]).select("id", "low")))
        keyed = id_and_text(docs, id_col, text_col).withColumn("_key", F.xxhash64("text"))
        met = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("_key") == F.col("id"))).select("id", "text")
        return map_blocks(met, work, "id long, codes array<long>").dropDuplicates(["id"])

    nodes = texts.select("text_key", "fp")
    near = neighbours.linked(neighbours.assemble(nodes, rows, codes_of, least, ways=neighbours.steps(least, BANDS, ROWS), n_bits=BANDS * ROWS))
    side = lambda key, name: nodes.select(F.col("text_key").alias(key), F.col("fp").alias(name))
    return near.join(side("id", "a"), "id").join(side("other", "b"), "other").select("a", "b")


def _members(docs: DataFrame, id_col: str, text_col: str, least: float | None = None) -> DataFrame:
    """``doc_id, text_key, fp, component_id`` of every row."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, least is not None))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(distinct.select("fp"))
    if least is not None:
        edges = edges.union(similar_links(docs, marked, least, id_col, text_col))
        marked = marked.drop("bands", "bits", "size")
    roots = components(edges)
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``: the smallest id reachable over links of TAU bits.

    Equal texts have equal fingerprints and are one node, so groups of copies are never expanded.  Texts that are null,
    empty or all white space have fingerprint zero.  Rows with a null id take part; a component of only such rows has a
    null id.  Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    return _members(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float | None = None) -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the smallest id (null ids last), then the
    smallest hash of the text; of rows equal in both, one.  With ``least``, texts whose shingles of WORDS words have at
    least this Jaccard similarity are linked too."""
    members = cut_lineage(_members(docs, id_col, text_col, least))
    rank = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_key")
    heads = members.groupBy("root").agg(F.min(rank).alias("rank")).select("rank")
    keys = members.withColumn("rank", rank).groupBy("rank", "doc_id", "text_key").agg(F.count("*").alias("n"))
    gone = neighbours.small(cut_lineage(keys.join(heads, "rank", "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))))
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same = lambda: F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (key == F.col("_key"))
    kept = docs.join(gone, same(), "left_anti")
    repeated = cut_lineage(keys.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, same(), "left_semi").withColumn("_key", key).dropDuplicates([id_col, "_key"]).drop("_key")
    return kept.join(repeated, same(), "left_anti").unionByName(once)
