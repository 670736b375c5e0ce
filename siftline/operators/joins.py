"""Joins that are more than one equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import similarity, text as T
from siftline.operators import neighbours
from siftline.session import cut_lineage


def allow_listed(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose ``column`` is listed; an empty list keeps all."""
    listed = allowed.select(F.col(allowed.columns[0]).alias(column)).distinct()
    guard = listed.agg((F.count(F.lit(1)) == 0).alias("empty")).scalar()
    member = listed.withColumn("_listed", F.lit(True))
    return df.join(member, column, "left").filter(F.coalesce("_listed", F.lit(False)) | guard).drop("_listed")


def block_listed(df: DataFrame, column: str, blocked: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not listed; null values stay."""
    listed = blocked.select(F.col(blocked.columns[0]).alias(column)).distinct()
    return df.join(listed, column, "left_anti")


def by_name_or_id(
    df: DataFrame, people: DataFrame, name: tuple[str, str], ident: tuple[str, str], take: str, out: str
) -> DataFrame:
    """Match by name, else by id: two hash joins instead of one OR join.

    ``name`` and ``ident`` are (column in df, column in people); names and ids are unique in ``people``.
    """
    by_name = people.select(F.col(name[1]).alias(name[0]), F.col(take).alias("_by_name"))
    by_id = people.select(F.col(ident[1]).alias(ident[0]), F.col(take).alias("_by_id"))
    return (
        df.join(by_name, name[0], "left")
        .join(by_id, ident[0], "left")
        .withColumn(out, F.coalesce("_by_name", "_by_id"))
        .drop("_by_name", "_by_id")
    )


def hash_then_prefix(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, digest, prefix: int = 100
) -> DataFrame:
    """Match texts by hash; unmatched ones by ``right LIKE left[:prefix] || '%'``.  Smallest id wins.

    Texts that share a head need not be alike, so ``similarity`` compares the whole texts of a match: the share of their words
    that they have in common, 1 for equal hashes.

    The right side is reduced to its first row per hash and per prefix before each join, so copies of
    one text cannot multiply.  Left texts shorter than the prefix are compared at their own length.
    """
    first_by_hash = right.groupBy(digest(F.col(text)).alias("_hash")).agg(F.min(right_id).alias("_hit"))
    # at most `prefix` different sizes exist
    sizes = left.agg(F.sort_array(F.collect_set(F.least(F.length(text), F.lit(prefix))))).scalar()
    probe = left.select(
        left_id,
        digest(F.col(text)).alias("_hash"),
        F.substring(text, 1, prefix).alias("_prefix"),
        F.least(F.length(text), F.lit(prefix)).alias("_size"),
    )
    matched = probe.join(first_by_hash, "_hash", "left")
    first_by_prefix = (
        right.select(right_id, F.substring(text, 1, prefix).alias("_head"), sizes.alias("_sizes"))
        .withColumn("_size", F.explode(F.filter("_sizes", lambda n: n <= F.length("_head"))))
        .groupBy(F.expr("substring(_head, 1, _size)").alias("_prefix"), "_size")
        .agg(F.min(right_id).alias("_retry"))
    )
    open_prefix = F.when(F.col("_hit").isNull(), F.col("_prefix"))  # a null key matches nothing
    retried = matched.withColumn("_prefix", open_prefix).join(first_by_prefix, ["_prefix", "_size"], "left")
    found = cut_lineage(
        retried.select(
            left_id,
            F.coalesce("_hit", "_retry").alias("match_id"),
            F.when(F.col("_hit").isNotNull(), "hash").when(F.col("_retry").isNotNull(), "prefix").alias("match_by"),
        )
    )
    by_head = found.where("match_by = 'prefix'").select(left_id, "match_id")
    mine = left.join(neighbours.small(by_head.select(left_id).distinct()), left_id).select(left_id, words(F.col(text)).alias("_mine"))
    hits = right.withColumnRenamed(right_id, "match_id").join(neighbours.small(by_head.select("match_id").distinct()), "match_id")
    near = by_head.join(mine, left_id).join(hits.select("match_id", words(F.col(text)).alias("_theirs")), "match_id")
    near = near.select(left_id, F.round(similarity.jaccard(F.col("_mine"), F.col("_theirs")), 6).alias("_near"))
    return found.join(near, left_id, "left").select(left_id, "match_id", "match_by", F.when(F.col("match_by") == "hash", 1.0).otherwise(F.col("_near")).alias("similarity"))


def words(text: Column) -> Column:
    """Distinct words of the lower-cased text, between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"[{T.SPACE}]+"), lambda w: w != ""))


def containing(
    left: DataFrame, left_text: str, right: DataFrame, right_text: str
) -> DataFrame:
    """Pairs where ``left_text`` contains ``right_text``, as an equality join.

    Each left text is cut into its substrings of the lengths that occur on the right.  Meant for names
    and titles: the work per row is its length times the number of different lengths.
    """
    lengths = right.agg(F.sort_array(F.collect_set(F.length(right_text)))).scalar()
    text = F.col(left_text)
    cuts = (
        left.withColumn("_lengths", lengths)
        .withColumn("_n", F.explode(F.filter("_lengths", lambda n: (n > 0) & (n <= F.length(text)))))
        .drop("_lengths")
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)))
        .withColumn("_cut", F.expr(f"substring({left_text}, _at, _n)"))
        .drop("_n", "_at")
        .dropDuplicates([left_text, "_cut"])
    )
    return cuts.join(right, F.col("_cut") == F.col(right_text)).drop("_cut")


def another_row_exists(
    df: DataFrame, key: str, ident: str, condition: Column
) -> DataFrame:
    """Rows for which another row of the same key (different id) meets ``condition``.

    A per-key count with the single qualifying id answers it without a self-join of rows.
    """
    hits = (
        df.filter(condition)
        .groupBy(key)
        .agg(F.min(ident).alias("_lo"), F.max(ident).alias("_hi"))
    )
    return (
        df.join(hits, key)
        .filter((F.col("_lo") != F.col(ident)) | (F.col("_hi") != F.col(ident)))
        .drop("_lo", "_hi")
    )


def best_case(
    leads: DataFrame,
    cases: DataFrame,
    speciality: str,
    niche: str,
    niche_words: str,
) -> DataFrame:
    """Best case per (speciality, niche): niche score first, then speciality alone at 0.5, else none.

    ``cases``: case_id, case_order, speciality, case_niche, case_words (a dimension).
    Equal leads are collapsed before the join, so the join grows with distinct niches, not with rows.
    """
    wanted = leads.select(speciality, niche, niche_words).distinct()
    name, words = F.lower(niche), F.transform(F.col(niche_words), lambda w: F.lower(w))
    case_words = F.transform(F.col("case_words"), lambda w: F.lower(w))
    score = (
        F.when((name != "") & (F.col("case_niche") != "") & F.lower("case_niche").contains(name), 1.0).otherwise(0.0)
        + F.when(
            (F.size(words) > 0) & (F.size(case_words) > 0),
            F.size(F.array_intersect(words, case_words)) / F.size(F.array_distinct(case_words)),
        ).otherwise(0.0)
        + 0.3 * F.when(name != "", F.size(F.filter(case_words, lambda w: name.contains(w)))).otherwise(0)
    )
    pairs = wanted.join(cases, speciality).withColumn("_score", F.least(F.round(score, 6), F.lit(1.0)))
    best = pairs.groupBy(speciality, niche).agg(
        F.max_by(
            F.struct("case_id", "_score"),
            F.struct("_score", (-F.col("case_order")).alias("first")),
        ).alias("_best"),
        F.min_by("case_id", "case_order").alias("_fallback"),
    )
    chosen = best.select(
        speciality,
        niche,
        F.when(F.col("_best._score") > 0, F.col("_best.case_id")).otherwise(F.col("_fallback")).alias("case_id"),
        F.when(F.col("_best._score") > 0, F.col("_best._score")).otherwise(F.lit(0.5)).alias("match_score"),
    )
    return leads.join(chosen, [speciality, niche], "left")


def first_service(
    leads: DataFrame, category: str, aliases: dict[str, str], services: DataFrame, name: str, service_id: str
) -> DataFrame:
    """Map a category through an alias table, then take the first service whose name contains the alias."""
    targets = sorted(set(aliases.values()))
    hits = (
        services.withColumn(
            "_target",
            F.explode(
                F.filter(F.array(*map(F.lit, targets)), lambda a: F.contains(F.lower(name), F.lower(a)))
            ),
        )
        .groupBy("_target")
        .agg(F.min(service_id).alias("service_id"))
    )
    mapping = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return leads.withColumn("_target", F.try_element_at(mapping, F.col(category))).join(hits, "_target", "left").drop(
        "_target"
    )
