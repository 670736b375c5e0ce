"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit signatures, in built-in functions.

Each shingle is hashed once; the high bits choose one of 256 bins, which keeps its least hash.  All hashes of a document
are sorted together with one sentinel for each bin (the bin's largest value), so the first value of each bin is its
minimum, or the sentinel if the bin is empty.  An empty bin takes over the value of a filled one chosen by a hash of
the bin and the attempt: the same choices for every document, so equal sets agree and unequal ones collide at the rate
of their similarity.  Of each value the lowest four bits are stored; a share of 1/16 of unequal bins agrees by chance,
for which the estimate is corrected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import let
from siftline.llm.blocks import id_and_text
from siftline.session import cut_lineage

SHINGLE = 5
BIN_BITS, KEPT_BITS = 8, 4
BINS = 1 << BIN_BITS
#: Attempts written out; only documents with few filled bins need more, and then choose the filled bin of least hash.
ATTEMPTS = 10
SPACE = r"[\x20\x09-\x0D]+"
#: Consecutive ids handled as one group when each document looks up the next one.
STRIDE = 256


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles (of the whole sequence if it is shorter); an empty array without words."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    cut = lambda h: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (size - 1))), lambda p: F.xxhash64(F.slice(h, p, size))
    )
    return let(hashes, lambda h: F.when(F.size(h) > 0, cut(h)).otherwise(F.array().cast("array<bigint>")))


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS)


def _minima(hashes: Column) -> Column:
    """The least hash of each bin, a bin's sentinel where it is empty; BINS values ordered by signed value."""
    ends = F.array(*[F.lit((b << (64 - BIN_BITS)) + (1 << (64 - BIN_BITS)) - 1) for b in range(-BINS // 2, BINS // 2)])
    ordered = F.sort_array(F.concat(hashes, ends))
    return let(ordered, lambda s: F.filter(s, lambda v, i: (i == 0) | (_bin(v) != _bin(F.get(s, i - 1)))))


def _filled(value: Column) -> Column:
    mask = (1 << (64 - BIN_BITS)) - 1
    return value.bitwiseAND(F.lit(mask)) != mask


def _densify(minima: Column) -> Column:
    """A filled value for each bin; unchanged if all are filled."""

    def fill(m, taken):
        def pick(value, i):
            tries = [F.get(m, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(ATTEMPTS)]
            rest = F.array_min(F.transform(taken, lambda v: F.struct(F.xxhash64(i, _bin(v)).alias("order"), v.alias("v"))))["v"]
            return F.when(_filled(value), value).otherwise(F.coalesce(*[F.when(_filled(t), t) for t in tries], rest))

        return F.transform(m, pick)

    return let(minima, lambda m: let(F.filter(m, _filled), lambda taken: F.when(F.size(taken) == BINS, m).otherwise(fill(m, taken))))


def fingerprint(text: Column) -> Column:
    """Packed signature: one hexadecimal digit for each bin; the empty string for a text without words.

    The digit is the low bits of a hash of the bin's value and the bin, so that bins filled from the same value, of which
    short texts have many, agree by chance independently of each other.
    """
    digit = lambda v: F.substring(F.lit("0123456789abcdef"), v.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int") + 1, F.lit(1))
    packed = lambda h: F.array_join(F.transform(_densify(_minima(h)), lambda v, i: digit(F.xxhash64(v, i))), "")
    return let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, packed(h)).otherwise(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of the shingles behind two fingerprints, corrected for chance agreement.

    Equal fingerprints, also two empty ones, give 1; an empty and another one 0.
    """
    same = F.aggregate(
        F.sequence(F.lit(1), F.lit(BINS)),
        F.lit(0),
        lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0),
    )
    chance = 1.0 / (1 << KEPT_BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


#: So few groups are ordered in one window; more are grouped again.
FEW_GROUPS = 10_000


def _following(ids: DataFrame) -> DataFrame:
    """``id, next`` for distinct whole numbers: the next larger one; for the largest, the least."""
    if ids.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        order = Window.orderBy("id")
        everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ids.select("id", F.coalesce(F.lead("id").over(order), F.min("id").over(everything)).alias("next"))
    grouped = ids.withColumn("group", F.floor(F.col("id") / STRIDE).cast("long"))
    led = grouped.withColumn("next", F.lead("id").over(Window.partitionBy("group").orderBy("id")))
    bounds = grouped.groupBy("group").agg(F.min("id").alias("low"), F.max("id").alias("id"))
    after = _following(bounds.select(F.col("group").alias("id")))
    jumps = bounds.select("group", "id").join(after.withColumnRenamed("id", "group"), "group").select("id", F.col("next").alias("to"))
    return led.where("next IS NOT NULL").select("id", "next").union(
        jumps.join(bounds.select(F.col("group").alias("to"), F.col("low").alias("next")), "to").select("id", "next")
    )


#: Up to so many (group, id) pairs are broadcast to fetch first rows that ids of multiples of STRIDE do not announce.
FEW_JUMPS = 100_000


def with_next(rows: DataFrame, id_col: str, ties: list[str], carried: list[str], derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Adds ``next_<column>``: the ``carried`` columns of the following row by id (then ``ties``); after the last, the first.

    ``derive`` adds columns that are dear to compute: it is applied once to all rows, and to those that are fetched.

    Rows are grouped by a stride of ids, so no task orders more than a stride of them (and rows of equal id).  A row
    whose id starts a stride is also sent to the group before it, whose last row needs it; this moves each row once.
    Groups that no such row follows (gaps, the very last group) fetch the first row of the next group by its id, which
    a pass over the ids alone has found.  Null ids come first.
    """
    group = F.floor(F.coalesce(F.col(id_col), F.lit(-(1 << 62))) / STRIDE).cast("long")
    bounds = rows.select(group.alias("group"), F.col(id_col).alias("low")).groupBy("group").agg(F.min("low").alias("low"))
    after = _following(bounds.select(F.col("group").alias("id")))
    jumps = cut_lineage(
        after.join(bounds.withColumnRenamed("group", "next"), "next")
        .where(F.col("low").isNull() | (F.col("next") != F.col("id") + 1) | (F.col("low") != F.col("next") * STRIDE))
        .select(F.col("id").alias("_from"), F.col("low").alias("_low"))
    )
    few = jumps.limit(FEW_JUMPS + 1).count() <= FEW_JUMPS
    fetched = derive(rows.join(F.broadcast(jumps) if few else jumps, F.col(id_col).eqNullSafe(F.col("_low"))))
    rows = derive(rows)
    first = fetched.groupBy("_from").agg(F.min_by(F.struct(*carried), F.struct(*ties)).alias("_first"))
    homes = F.when(F.col(id_col) % STRIDE == 0, F.array(group, group - 1)).otherwise(F.array(group))
    sent = rows.select("*", F.explode(homes).alias("_group"))
    order = Window.partitionBy("_group").orderBy(id_col, *ties)
    led = sent.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried], F.lead(F.lit(1)).over(order).alias("_more"))
    own = led.where(F.col("_group") == group)
    joined = own.join(first, (F.col("_group") == F.col("_from")) & F.col("_more").isNull(), "left")
    return joined.select(*rows.columns, *[F.when(F.col("_more").isNull(), F.col(f"_first.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carried])


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like its fingerprint is to the edited text's and the next one's.

    Edited: the last quarter of the code points (rounded down) is replaced by the first as many of the next text.
    Null and empty texts have the empty fingerprint, texts of fewer than five words one shingle.  Rows of equal id are
    ordered by text; a single row is its own next; an empty table gives no rows; other columns are not read.
    """
    marked = lambda rows: rows.withColumn("fingerprint", fingerprint(F.col("text")))
    led = with_next(id_and_text(docs, id_col, text_col), "doc_id", ["text"], ["text", "fingerprint"], marked)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    made = led.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e).alias("fp"))).alias("edited"),
    )
    made = made.select("doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), "fingerprint", F.col("edited.fp").alias("edited_fingerprint"), "next_fingerprint")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
