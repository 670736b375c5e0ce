"""Benchmark decontamination: word windows of the test items as a broadcast hash set, scanned over whole documents.

Each document is read once.  Its words are hashed, the hashes of its windows are tested against the set inside the
expression (no row is made for a window that misses), and the few hits are verified word for word by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import cut_lineage

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct windows (8 bytes each as hashes) go with the plan as a set; more are joined by hash.
SET_LIMIT = 100_000
#: Bytes of windows that are broadcast to verify hits; more are joined.
BYTES_LIMIT = 64_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; lower() does that on texts of ASCII only, and faster."""
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item`` (id as text), ``window`` (its words joined by a space), ``len``, ``hash``: one row for each window of an item."""
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).where("size(w) > 0")
    rows = cut.select("item", "w", F.expr(f"least(size(w), {window})").alias("len")).select(
        "item", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), p -> slice(w, p, len))")).alias("ws")
    )
    return rows.select("item", "len", F.array_join("ws", " ").alias("window"), F.expr("xxhash64(transform(ws, w -> xxhash64(w)))").alias("hash")).distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _window_hash(size: int) -> str:
    return f"xxhash64(slice(h, p, {size}))"


def _hits_by_set(keyed: DataFrame, sets: dict[int, list[int]]) -> DataFrame:
    """``doc_id, text_key, n_words, hit``: windows whose hash is in the set, and one row with null for every document."""
    found = [
        f"transform(filter(if(size(h) < {n}, cast(array() as array<int>), sequence(1, greatest(1, size(h) - {n} + 1))), "
        f"p -> {_window_hash(n)} IN ({','.join(map(str, hashes))})), "
        f"p -> struct(p AS pos, {n} AS len, array_join(slice(w, p, {n}), ' ') AS window))"
        for n, hashes in sorted(sets.items())
    ]
    none = "array(cast(null AS struct<pos: int, len: int, window: string>))"
    scan = f"transform(array(w), w -> transform(array(transform(w, x -> xxhash64(x))), h -> struct(size(w) AS n_words, concat({', '.join([none, *found])}) AS hits))[0])[0]"
    return keyed.select("doc_id", "text_key", words(F.col("text")).alias("w")).select("doc_id", "text_key", F.expr(scan).alias("scan")).select(
        "doc_id", "text_key", "scan.n_words", F.explode("scan.hits").alias("hit")
    )


def _hits_by_join(keyed: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for a benchmark of any size: hashes of all document windows joined with those of the items."""
    hashed = keyed.select("doc_id", "text_key", words(F.col("text")).alias("w")).select(
        "doc_id", "text_key", F.size("w").alias("n_words"), F.expr("transform(w, x -> xxhash64(x))").alias("h")
    )
    each = [
        f"if(size(h) < {n}, cast(array() as array<struct<pos: int, len: int, hash: bigint>>), "
        f"transform(sequence(1, greatest(1, size(h) - {n} + 1)), p -> struct(p AS pos, {n} AS len, {_window_hash(n)} AS hash)))"
        for n in sizes
    ]
    at = hashed.select("doc_id", "text_key", F.explode(F.expr(f"transform(array(h), h -> concat({', '.join(each)}))[0]")).alias("c"))
    hits = at.join(windows.select(F.col("hash").alias("known")).distinct(), F.col("c.hash") == F.col("known"), "left_semi")
    places = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("c.pos", "c.len")).alias("places"))
    once = keyed.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", words(F.col("text")).alias("w"))
    texts = once.join(places, (once.doc_id.eqNullSafe(places.doc_id)) & (once.text_key == places.text_key)).select(
        once.doc_id, once.text_key, F.size("w").alias("n_words"),
        F.explode(F.expr("transform(places, x -> struct(x.pos AS pos, x.len AS len, array_join(slice(w, x.pos, x.len), ' ') AS window))")).alias("hit"),
    )
    return hashed.select("doc_id", "text_key", "n_words", F.lit(None).cast("struct<pos: int, len: int, window: string>").alias("hit")).union(texts)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = 20,
    set_limit: int = SET_LIMIT,
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside occurrences of item windows), ``n_items``, ``item_ids``,
    ``contaminated`` (hit words are at least one in ``share``), and ``text_key``, a hash of the text.

    Items with fewer words than ``window`` are one window of all their words; items without words have none, and items
    with a null id count under the empty id.  Null and empty texts have no words and are clean.  Repeated rows are
    returned as often as they occur; an empty benchmark leaves every document clean; other columns are not read.
    """
    of_items = benchmark_windows(items, item_col, item_text, window)
    windows = of_items.select("window", "len", "hash").distinct()
    keyed = _keyed(docs, id_col, text_col)
    known = windows.select("len", "hash").limit(set_limit + 1).collect()  # bounded: a larger benchmark is not collected
    sizes = sorted({r["len"] for r in known}) if len(known) <= set_limit else list(range(1, window + 1))
    table = windows.select("window", "len", F.lit(True).alias("known"))
    if len(known) <= set_limit:
        hits = _hits_by_set(keyed, {n: sorted({r["hash"] for r in known if r["len"] == n}) for n in sizes})
        if (windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0) <= BYTES_LIMIT:
            table = F.broadcast(table)  # at most set_limit rows and BYTES_LIMIT bytes, whatever the number of items
    else:
        hits = _hits_by_join(keyed, windows, sizes)
    flat = hits.select("doc_id", "text_key", "n_words", "hit.pos", F.col("hit.len").alias("len"), F.col("hit.window").alias("window"))
    verified = flat.join(table, ["window", "len"], "left").where("pos IS NULL OR known")
    grouped = verified.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(F.col("pos").isNull()).alias("copies"),
        F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "len"))).alias("places"),
        F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("window", "len"))).alias("windows"),
    )
    grouped = cut_lineage(grouped)  # read twice
    # items are looked up by window for the documents that have hits, so that a window of many items is not gathered before
    hit = grouped.where(F.size("windows") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.explode("windows").alias("w"))
    found = hit.select("_id", "_key", "w.window", "w.len").join(of_items, ["window", "len"]).groupBy("_id", "_key").agg(F.collect_set("item").alias("items"))
    grouped = grouped.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))
    counted = grouped.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "copies",
        F.when(F.size("places") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_hit"),
        F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("item_ids"),
    )
    return counted.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were; clean documents stay as they are."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")
    ).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text) == F.col("_bad_key")), "left_anti")
