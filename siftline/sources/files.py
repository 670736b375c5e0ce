"""Readers and writers for the file shapes of a message-triage store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_JSON = "positive ARRAY<STRING>, negative ARRAY<STRING>, last_updated STRING, version INT"
CASES_JSON = (
    "cases ARRAY<STRUCT<case_id: STRING, specialization: STRING, niche: STRING, niche_keywords: ARRAY<STRING>, "
    "results: MAP<STRING, STRING>, short_description: STRING, case_link: STRING>>"
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule JSON as rows (polarity, pattern); empty when the file is missing."""
    empty = spark.createDataFrame([], "polarity STRING, pattern STRING, ordinal INT, version INT")
    try:
        raw = spark.read.schema(RULES_JSON).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise

    def side(name):
        return raw.select(F.lit(name).alias("polarity"), F.posexplode(name).alias("ordinal", "pattern"), "version").select(
            "polarity", "pattern", "ordinal", "version"
        )

    return side("positive").union(side("negative"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a nested JSON document, one row each in document order."""
    raw = spark.read.schema(CASES_JSON).option("multiLine", True).json(path)
    return raw.select(F.posexplode("cases").alias("case_order", "case")).select("case_order", "case.*")


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Whole text files with their name."""
    return (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, lines, bytes and last change per file extension."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"\.([^.]+)$", 1).alias("extension"),
        F.size(F.split("value", "\n")).cast("long").alias("lines"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    return files.groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"),
        F.max("modified").alias("last_modified"),
    )


def write_csv(df: DataFrame, path: str, order: list[Column]) -> None:
    """Ordered CSV with a header line per file."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json_by_relevance(df: DataFrame, path: str, flag: str = "is_relevant") -> None:
    df.write.mode("overwrite").partitionBy(flag).json(path)


def write_lines(df: DataFrame, line: str, path: str, order: list[Column]) -> None:
    """Report lines as text, in order."""
    df.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)
