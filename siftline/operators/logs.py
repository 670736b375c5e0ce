"""Progress logs of parallel scans: parsing and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes of the log lines.
PROGRESS = r"\[(\d+)\] ⏳ (.+): processed (\d+) msgs"
DONE = r"\[(\d+)\] ✅ DONE: (.+) \((\d+) msgs\)"
EMPTY = r"\[(\d+)\] ⚪ EMPTY:"
LEAD = r"✅ Найдено! .* Spec: (.+)"


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add kind, chat index, name, count and specialisation."""
    v = F.col(value)
    kind = (
        F.when(v.rlike(DONE), "done")
        .when(v.rlike(PROGRESS), "progress")
        .when(v.rlike(EMPTY), "empty")
        .when(v.rlike(LEAD), "lead")
        .otherwise("other")
    )

    def field(group):
        return (
            F.when(F.col("kind") == "progress", F.regexp_extract(v, PROGRESS, group))
            .when(F.col("kind") == "done", F.regexp_extract(v, DONE, group))
        )

    index = F.coalesce(field(1), F.when(F.col("kind") == "empty", F.regexp_extract(v, EMPTY, 1)))
    return (
        lines.withColumn("kind", kind)
        .withColumn("chat_index", index.cast("long"))
        .withColumn("name", F.trim(field(2)))
        .withColumn("messages", field(3).cast("long"))
        .withColumn("specialisation", F.when(F.col("kind") == "lead", F.trim(F.regexp_extract(v, LEAD, 1))))
    )


def totals(parsed: DataFrame, line_no: str, estimate: int) -> DataFrame:
    """Messages of finished chats plus the latest count of those still running."""
    per_chat = parsed.filter(F.col("chat_index").isNotNull()).groupBy("chat_index").agg(
        F.max_by("kind", line_no).alias("_last"),
        F.count_if(F.col("kind").isin("done", "empty")).alias("_finished"),
        F.sum(F.when(F.col("kind") == "done", F.col("messages"))).alias("_done"),
        F.max_by("messages", line_no).alias("_latest"),
    )
    running = F.when(F.col("_last") == "progress", F.col("_latest")).otherwise(0)
    scanned = F.coalesce(F.sum(F.coalesce("_done", F.lit(0)) + running), F.lit(0))
    return per_chat.agg(
        F.coalesce(F.sum("_finished"), F.lit(0)).cast("long").alias("chats_done"),
        scanned.cast("long").alias("scanned"),
        F.count_if(F.col("_last") == "progress").alias("active"),
        F.round(scanned * 100.0 / estimate, 4).alias("percent"),
    )


def join_counts(lines: DataFrame, success: str, member: str, value: str = "value") -> DataFrame:
    v = F.col(value)
    return lines.agg(
        F.count_if(F.contains(v, F.lit(success))).alias("joined"),
        F.count_if(F.contains(v, F.lit(member))).alias("already_member"),
    )
