"""Similarities of vectors, shingle sets and texts."""

from __future__ import annotations

import difflib
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from siftline.functions import text as T
from siftline.session import bound_batches, cut_lineage


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).otherwise(F.lit(0.0))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct ``size``-character shingles of the lower-cased letters, digits and white space."""
    clean = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{T.SPACE}]", "")

    def cut(s):
        starts = F.when(F.length(s) >= size, F.sequence(F.lit(1), F.length(s) - (size - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(size))))

    return T.let(clean, cut)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets held as distinct arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def ratio_above(least: float):
    """Arrow function of two texts -> their matching-blocks ratio if it is above ``least``, else null; the quick bounds on the
    ratio (lengths, then characters in common) are tried first."""

    def ratio(a, b):
        a, b = (a or "").lower().strip(), (b or "").lower().strip()
        if not a or not b:
            return None
        if a == b:
            return 1.0 if least < 1 else None
        match = difflib.SequenceMatcher(None, a, b)
        if match.real_quick_ratio() <= least or match.quick_ratio() <= least:
            return None
        found = match.ratio()
        return found if found > least else None

    bound_batches()

    @F.pandas_udf(DoubleType())
    def made(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")

    return made


@F.pandas_udf(DoubleType())
def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    def ratio(a, b):
        if not a or not b:
            return 0.0
        return difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def sequence_ratio(left, right) -> Column:
    """Matching-blocks ratio of two texts; for candidate pairs only."""
    return _sequence_ratio(left, right)


def _encode(text, size: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles of a text, in linear time."""
    clean = "".join(c for c in (text or "").lower() if c.isalnum() or c.isspace())
    points = np.frombuffer(clean.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h.view(np.int64))


def _hash_family(n: int):
    rng = np.random.default_rng(42)
    odd = rng.integers(1, 2**63, size=n, dtype=np.uint64) | np.uint64(1)
    return odd, rng.integers(0, 2**63, size=n, dtype=np.uint64)


def _band_keys(codes: np.ndarray, bands: int, rows: int, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the MinHash signature."""
    if len(codes) == 0:
        return np.empty(0, dtype=np.int64)
    lows = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(codes), 512):  # blocks that fit the processor cache, also for long texts
        block = codes.view(np.uint64)[start : start + 512, None] * odd[None, :] + add[None, :]
        block ^= block >> np.uint64(32)
        lows = np.minimum(lows, block.min(axis=0))
    key = np.zeros(bands, dtype=np.uint64)
    for r in range(rows):
        key = key * np.uint64(0x100000001B3) + lows.reshape(bands, rows)[:, r]
    return (key * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def shingle_codes(size: int):
    """Arrow function text -> shingle codes."""
    bound_batches()

    @F.pandas_udf(ArrayType(LongType()))
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: _encode(s, size))

    return codes


#: One bit of each of so many MinHash values tells how similar two sets are, before they are compared.
BITS = 128
SKETCH = StructType(
    [StructField("same", BinaryType()), StructField("keys", ArrayType(LongType())), StructField("first", IntegerType()), StructField("size", IntegerType()), StructField("bits", ArrayType(LongType()))]
)


def _sketches(rows: list[tuple]) -> pd.DataFrame:
    same, keys, first, size, bits = zip(*rows) if rows else ((),) * 5
    return pd.DataFrame({"same": list(same), "keys": list(keys), "first": np.array(first, np.int32), "size": np.array(size, np.int32), "bits": list(bits)})


def _digest(codes: np.ndarray, text: str) -> bytes:
    """128 bits of a set of shingles; of the text itself where the set is empty."""
    return hashlib.blake2b(codes.tobytes() if len(codes) else b"text:" + (text or "").lower().encode("utf-8"), digest_size=16).digest()


def _bits(codes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The lowest bit of each MinHash value of the family, as 64-bit numbers; empty without codes."""
    if not len(codes):
        return np.empty(0, np.int64)
    lows = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(codes), 512):
        block = codes.view(np.uint64)[start : start + 512, None] * odd + add
        block ^= block >> np.uint64(32)
        lows = np.minimum(lows, block.min(axis=0))
    lows ^= lows >> np.uint64(29)
    lows *= np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits((lows >> np.uint64(40) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8")


def sketch(size: int, bands: int, rows: int):
    """Arrow function text -> struct: a 128-bit digest of its shingle set, its band keys (all of which place it), the number of
    shingles, and bits of its MinHash values.  Small, whatever the length of the text."""
    odd, add = _hash_family(max(bands * rows, BITS))
    bound_batches()

    def one(text):  # the codes of a text, which are larger than it, are held for one text at a time
        codes = _encode(text, size)
        keys = _band_keys(codes, bands, rows, odd[: bands * rows], add[: bands * rows])
        return _digest(codes, text), keys, len(keys), len(codes), _bits(codes, odd[:BITS], add[:BITS])

    @F.pandas_udf(SKETCH)
    def made(texts: pd.Series) -> pd.DataFrame:
        return _sketches([one(s) for s in texts])

    return made


def prefix(size: int, threshold: float, frequencies: np.ndarray):
    """Arrow function text -> the struct of ``sketch`` with the rarest shingle codes as keys: of ``n``, the first
    ``n - ceil(threshold * n) + 1`` place the text, one more serves to split groups.  ``frequencies``: by low bits of the code."""

    bound_batches()

    def one(text):
        codes = _encode(text, size)
        first = len(codes) - int(np.ceil(threshold * len(codes) - 1e-9)) + 1 if len(codes) else 0
        keys = codes[np.argsort(frequencies[codes & (len(frequencies) - 1)], kind="stable")][: first + 1]
        return _digest(codes, text), keys, first, len(codes), np.empty(0, np.int64)

    @F.pandas_udf(SKETCH)
    def made(texts: pd.Series) -> pd.DataFrame:
        return _sketches([one(s) for s in texts])

    return made


#: Directions of a hash, hashes of a table key, and sign bits that tell how close two vectors are before they are compared.
DIRECTIONS, JOINED, SIGNS = 64, 2, 256


def _agreement(threshold: float) -> float:
    """Chance that a hash agrees for two vectors at the threshold: of DIRECTIONS random directions, and their opposites, both
    are nearest to the same one.  It depends on the cosine only, and is simulated."""
    rng = np.random.default_rng(17)
    a, z = rng.standard_normal((2, 20_000, DIRECTIONS), dtype=np.float32)
    b = threshold * a + np.sqrt(1 - threshold**2) * z
    i, j, row = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1), np.arange(len(a))
    return float(((i == j) & (a[row, i] * b[row, j] > 0)).mean())


def _direction_keys(tables: int):
    """Arrow function vector -> struct: its key in each table, and the signs of its projections as 64-bit numbers."""
    result = StructType([StructField("keys", ArrayType(LongType())), StructField("signs", ArrayType(LongType()))])
    bound_batches()

    @F.pandas_udf(result)
    def made(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"keys": pd.Series([], dtype=object), "signs": pd.Series([], dtype=object)})
        matrix = np.stack(vectors.to_numpy()).astype(np.float32)
        rng = np.random.default_rng(41)
        signs = (matrix @ rng.standard_normal((matrix.shape[1], SIGNS), dtype=np.float32) > 0).astype(np.uint8)
        keys = np.empty((len(matrix), tables), np.int64)
        for table in range(tables):
            planes = rng.standard_normal((matrix.shape[1], JOINED * DIRECTIONS), dtype=np.float32)
            ahead = (matrix @ planes).reshape(len(matrix), JOINED, DIRECTIONS)
            best = np.abs(ahead).argmax(axis=2)
            code = 2 * best + (np.take_along_axis(ahead, best[:, :, None], axis=2)[:, :, 0] > 0)
            keys[:, table] = table
            for part in code.T:
                keys[:, table] = keys[:, table] * (2 * DIRECTIONS) + part
        packed = np.packbits(signs, axis=1, bitorder="little").view("<i8")
        return pd.DataFrame({"keys": list(keys), "signs": list(packed)})

    return made


def _close(a: str, b: str, threshold: float) -> Column:
    """The signs of two aliased rows allow a cosine of ``threshold``; refused at the threshold with a chance below 1e-6."""
    rate = np.arccos(threshold) / np.pi
    most = int(SIGNS * rate + 5 * np.sqrt(SIGNS * rate * (1 - rate)))
    differ = [F.bit_count(F.get(f"{a}.signs", F.lit(i)).bitwiseXOR(F.get(f"{b}.signs", F.lit(i)))) for i in range(SIGNS // 64)]
    return sum(differ[1:], differ[0]) <= most


def _tables(threshold: float, miss: float) -> int:
    return int(np.ceil(np.log(miss) / np.log1p(-(_agreement(threshold) ** JOINED))))


def best_match(vectors: DataFrame, ident: str, vector: str, threshold: float, miss: float = 1e-4, earlier: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Best cosine match above ``threshold`` of every vector among all others (of equals the smallest id); null without one.
    With ``earlier``, among those of smaller id; with ``only``, for the ids of that table (others get any or no match).

    Vectors that are nearest to the same random directions in a table meet, and are compared exactly if their sign bits
    allow it.  There are as many tables as keep the chance to miss a pair at the threshold below ``miss``; unrelated vectors
    meet in 0.9 % of pairs at 0.75, 2.7 % at 0.60, and the bits keep them from being compared.  Equal vectors are one
    entry, so copies are never paired.
    """
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v")).filter(_dot(F.col("v"), F.col("v")) > 0)
    rows = rows.withColumn("h", F.xxhash64("v"))
    low = F.slice(F.array_sort(F.collect_set("id")), 1, 2)
    keys = _direction_keys(_tables(threshold, miss))
    groups = rows.groupBy("h", "v").agg(F.min("id").alias("rep"), low.alias("low")).withColumn("k", keys("v"))
    groups = cut_lineage(groups.select("h", "v", "rep", "low", "k.keys", "k.signs"))
    placed = groups.select("rep", "signs", F.explode("keys").alias("bucket"))
    met = (F.col("x.bucket") == F.col("y.bucket")) & _close("x", "y", threshold)
    if only is None:
        pairs = placed.alias("x").join(placed.alias("y"), met & (F.col("x.rep") < F.col("y.rep")))
    else:
        asked = cut_lineage(rows.join(only.select(F.col(ident).alias("id")), "id", "left_semi").join(groups.select("h", "v", "rep"), ["h", "v"]).select("rep").distinct())
        pairs = placed.join(asked, "rep", "left_semi").alias("x").join(placed.alias("y"), met & (F.col("x.rep") != F.col("y.rep")))
    pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    known = groups.select("rep", "v")
    scored = (
        pairs.join(known.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a")
        .join(known.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
        .select("a", "b", cosine(F.col("va"), F.col("vb")).alias("s"))
        .filter(F.col("s") > threshold)
    )
    backward = scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")
    best = (backward if earlier else scored.union(backward)).groupBy("a").agg(
        F.max(F.struct(F.round("s", 9).alias("k"), (-F.col("b")).alias("b"), "s")).alias("other")
    )
    of_group = groups.select("h", "v", "low", F.col("rep").alias("a")).join(best, "a", "left").select("h", "v", "low", "other")
    found = rows.join(of_group, ["h", "v"])
    twin = F.when(F.col("id") == F.get("low", F.lit(0)), F.get("low", F.lit(1))).otherwise(F.get("low", F.lit(0)))
    own = F.when(twin < F.col("id") if earlier else twin.isNotNull(), F.struct(F.lit(1.0).alias("k"), (-twin).alias("b"), F.lit(1.0).alias("s")))
    picked = found.select("id", F.greatest(own, F.col("other")).alias("m"))
    return vectors.select(F.col(ident).alias("id")).join(picked, "id", "left").select(
        F.col("id").alias(ident), (-F.col("m.b")).alias("best_id"), F.round("m.s", 6).alias("similarity"),
        F.col("m").isNotNull().alias("is_duplicate"),
    )
