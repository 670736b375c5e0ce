"""Keyword search and line search over text corpora."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siftline.functions.text import let
from siftline.operators.filters import query_tokens
from siftline.session import bound_batches

WORD = re.compile(r"\w+")


def keyword_hits(text: Column, tokens: list[str]) -> Column:
    wanted = F.array(*map(F.lit, tokens))
    return let(F.lower(text), lambda low: F.size(F.filter(wanted, lambda t: F.contains(low, t))))


def snippet(text: Column, token: str, before: int = 200, after: int = 800) -> Column:
    """Text around the first hit of ``token`` (the beginning where it does not occur)."""
    at = F.locate(token, F.lower(text), 1) - 1
    start = F.greatest(F.lit(0), at - before)
    return F.substring(text, start + 1, at + after - start)


def best_snippets(df: DataFrame, ident: str, text: str, question: str, top: int = 2) -> DataFrame:
    """The ``top`` texts with the most query words, with a snippet around the first word."""
    tokens = query_tokens(question, 4)
    if not tokens:
        return df.limit(0).select(ident, F.lit(0).alias("score"), F.col(text).alias("snippet"))
    score = keyword_hits(F.col(text), tokens)
    best = df.select(ident, score.alias("score"), text).filter("score > 0").orderBy(F.desc("score"), ident).limit(top)
    return best.select(ident, "score", snippet(F.col(text), tokens[0]).alias("snippet"))


@F.pandas_udf(ArrayType(StructType([StructField("term", StringType()), StructField("at", IntegerType())])))
def _places(texts: pd.Series) -> pd.Series:
    """Each word of a text with its first place, counted from 1."""

    def one(text):
        first: dict[str, int] = {}
        for m in WORD.finditer(text or ""):
            first.setdefault(m[0], m.start() + 1)
        return list(first.items())

    return texts.map(one)


def build_index(df: DataFrame, ident: str, text: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Postings ``(term, ident, at)`` and the terms, written once below ``folder`` and read from there.

    A term is a run of word characters of the lower-cased text; ``at`` is its first place.  Postings lie in order of term
    and id, so a frequent term is spread over files and a query reads the row groups of its terms only.
    """
    spark = df.sparkSession
    bound_batches()
    rows = df.select(ident, F.explode(_places(F.lower(F.col(text)))).alias("p")).select("p.term", ident, "p.at")
    rows.repartitionByRange("term", ident).sortWithinPartitions("term", ident).write.mode("overwrite").parquet(f"{folder}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{folder}/postings")
    postings.select("term").distinct().write.mode("overwrite").parquet(f"{folder}/terms")
    return postings, spark.read.schema("term string").parquet(f"{folder}/terms")


def indexed_snippets(index: tuple[DataFrame, DataFrame], df: DataFrame, ident: str, text: str, question: str, top: int = 2) -> DataFrame:
    """``best_snippets`` from the index: words of the question are found inside terms, scores come from postings, and only the
    ``top`` texts are read."""
    tokens = query_tokens(question, 4)
    if not tokens:
        return df.limit(0).select(ident, F.lit(0).alias("score"), F.col(text).alias("snippet"))
    if not all(WORD.fullmatch(t) for t in tokens):
        raise ValueError("words of a question have to be runs of word characters")
    postings, terms = index
    wanted = F.filter(F.array(*map(F.lit, dict.fromkeys(tokens))), lambda t: F.contains(F.col("term"), t))
    meant = terms.select("term", F.explode(wanted).alias("token"))
    times = {t: tokens.count(t) for t in tokens}
    weight = F.coalesce(*[F.when(F.col("token") == t, n) for t, n in times.items()])
    places = postings.join(meant, "term").groupBy(ident, "token").agg(F.min(F.col("at") + F.position(F.col("token"), F.col("term")) - 1).alias("at"))
    scored = places.groupBy(ident).agg(F.sum(weight).cast("int").alias("score"), F.max(F.when(F.col("token") == tokens[0], F.col("at"))).alias("at"))
    best = scored.orderBy(F.desc("score"), ident).limit(top)
    at = F.coalesce("at", F.lit(0)) - 1
    start = F.greatest(F.lit(0), at - 200)
    return df.join(F.broadcast(best), ident).select(ident, "score", F.substring(F.col(text), start + 1, at + 800 - start).alias("snippet"))


def grep(
    df: DataFrame, ident: str, text: str, needle: str, context: int = 1, case_sensitive: bool = False
) -> DataFrame:
    """Matching lines with ``context`` lines around each, one row per match."""
    fold = (lambda c: c) if case_sensitive else F.lower
    wanted = needle if case_sensitive else needle.lower()
    candidates = df.filter(F.contains(fold(F.col(text)), F.lit(wanted)))
    lines = candidates.select(ident, F.split(text, "\n").alias("_lines"))
    numbers = F.sequence(F.lit(1), F.size("_lines"))
    hits = F.filter(numbers, lambda i: F.contains(fold(F.element_at("_lines", i)), F.lit(wanted)))
    first = F.greatest(F.lit(1), F.col("line_no") - context)
    span = F.slice("_lines", first, F.col("line_no") + context - first + 1)
    return (
        lines.withColumn("line_no", F.explode(hits))
        .select(
            ident,
            "line_no",
            F.element_at("_lines", F.col("line_no")).alias("line"),
            F.array_join(span, "\n").alias("context"),
        )
    )


def corpus_stats(df: DataFrame, group: str, text: str, modified: str) -> DataFrame:
    """Files, lines, bytes and last change per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.size(F.split(text, "\n")).cast("long")).alias("lines"),
        F.sum(F.octet_length(text).cast("long")).alias("bytes"),
        F.max(modified).alias("last_modified"),
    )
