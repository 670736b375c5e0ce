"""Table maintenance as DataFrame jobs: every function returns the table's new contents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_first_wins(
    stored: DataFrame,
    incoming: DataFrame,
    key: str,
    order: Sequence[str],
    seen: str,
    keep: Sequence[str],
) -> DataFrame:
    """Insert by key; on conflict only ``seen`` moves, the other columns keep their first write.

    One aggregation with a map-side combine: copies of a hot key collapse before the shuffle.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    first = F.min_by(F.struct(*keep), F.struct("_new", *order))
    return (
        both.groupBy(key)
        .agg(first.alias("_first"), F.max(seen).alias(seen))
        .select(key, *[F.col(f"_first.{c}").alias(c) for c in keep], seen)
    )


def missing_rows(seed: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seed rows whose key the target lacks."""
    return seed.join(target.select(*keys).distinct(), list(keys), "left_anti")


def seed_if_empty(seed: DataFrame, target: DataFrame) -> DataFrame:
    """The seed, or nothing when the target has any row."""
    occupied = target.limit(1).select(F.lit(True).alias("_occupied"))
    return seed.withColumn("_k", F.lit(True)).join(occupied, F.col("_k") == F.col("_occupied"), "left_anti").drop("_k")


def retain_since(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    return df.filter(F.col(ts) >= cutoff)


def delete_matching(df: DataFrame, criteria: Sequence[Column]) -> DataFrame:
    """Delete rows that meet all criteria; refuses to empty the table for want of any."""
    if not criteria:
        raise ValueError("delete needs at least one criterion")
    condition = criteria[0]
    for more in criteria[1:]:
        condition = condition & more
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return df.join(doomed.select(key), key, "left_anti")


def set_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE."""
    hit = F.coalesce(condition, F.lit(False))
    names = set(df.columns)
    new = {
        name: F.when(hit, value).otherwise(F.col(name)) if name in names else F.when(hit, value)
        for name, value in values.items()
    }
    return df.withColumns(new)


def patch(df: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite only the fields a patch gives (its non-null ones); unknown keys are ignored."""
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def patch_or_insert(df: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Patch known keys and append rows for new ones."""
    fresh = patches.join(df.select(key), key, "left_anti")
    return patch(df, patches, key, columns).unionByName(fresh, allowMissingColumns=True)


def audit_rows(df: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], action: str) -> DataFrame:
    """One audit row per patched key with the old and the given new values as JSON."""
    old = df.select(key, F.to_json(F.struct(*columns)).alias("old_value"))
    new = patches.select(key, F.to_json(F.struct(*columns)).alias("new_value"))
    return old.join(new, key).select(
        F.lit(action).alias("action"), F.col(key).alias("entity_id"), "old_value", "new_value"
    )


def append_version(versions: DataFrame, changes: DataFrame, key: str, content: str) -> DataFrame:
    """Append ``version + 1`` where the content of a key really changes."""
    current = latest_version(versions, key, content)
    changed = (
        changes.select(key, F.col(content).alias("_new"))
        .join(current, key, "left")
        .filter(~F.col(content).eqNullSafe(F.col("_new")))
        .select(key, (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.col("_new").alias(content))
    )
    return versions.select(key, "version", content).unionByName(changed)


def latest_version(versions: DataFrame, key: str, content: str) -> DataFrame:
    return versions.groupBy(key).agg(
        F.max("version").alias("version"), F.max_by(content, "version").alias(content)
    )


def rollback(versions: DataFrame, target: DataFrame, key: str, content: str) -> DataFrame:
    """Append the content of an old version (``target``: key, version) as the newest one."""
    newest = versions.groupBy(key).agg(F.max("version").alias("_top"))
    old = versions.join(target, [key, "version"]).join(newest, key)
    return versions.select(key, "version", content).unionByName(
        old.select(key, (F.col("_top") + 1).alias("version"), content)
    )
