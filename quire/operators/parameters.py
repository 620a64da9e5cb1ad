"""Versioned, scoped configuration: effective values, next versions, snapshots, rollbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order of versions: newest last.
NEWEST = ("created_at", "run", "patch")


def _newest():
    return [F.desc(c) for c in NEWEST]


def active_versions(versions: DataFrame) -> DataFrame:
    """The newest active version of each key."""
    return versions.filter("status = 'active'").groupBy("key").agg(F.max_by("value", F.struct(*NEWEST)).alias("version_value"))


def applicable_overrides(overrides: DataFrame, as_of: str, brand: int) -> DataFrame:
    """The override of the highest priority that holds at a time for a brand (ties: the newest)."""
    at = F.lit(as_of).cast("timestamp_ntz")
    valid = overrides.filter((F.col("brand") == brand) & (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    return valid.groupBy("key").agg(F.max_by("value", F.struct("priority", "valid_from", "run", "patch")).alias("override_value"))


def effective(parameters: DataFrame, versions: DataFrame, overrides: DataFrame, as_of: str, brand: int) -> DataFrame:
    """Override, else active version, else default, for every parameter at once."""
    out = parameters.join(active_versions(versions), "key", "left").join(applicable_overrides(overrides, as_of, brand), "key", "left")
    return out.select("key", "category", F.coalesce("override_value", "version_value", "default_value").alias("value"), F.when(F.col("override_value").isNotNull(), "override").when(F.col("version_value").isNotNull(), "version").otherwise("default").alias("origin"))


def history(versions: DataFrame, n: int) -> DataFrame:
    """The newest n versions of each key."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(*_newest()))
    return versions.withColumn("rn", rn).filter(F.col("rn") <= n)


def next_version(versions: DataFrame, parameters: DataFrame) -> DataFrame:
    """The newest version's number with its patch raised by one; 1.0.0 without any."""
    last = versions.groupBy("key").agg(F.max_by("patch", F.struct(*NEWEST)).alias("patch"))
    return parameters.select("key").join(last, "key", "left").select("key", F.when(F.col("patch").isNull(), "1.0.0").otherwise(F.concat(F.lit("1.0."), (F.col("patch") + 1).cast("string"))).alias("next_version"))


def snapshot(values: DataFrame) -> DataFrame:
    """All values per category as one JSON object, its keys in order, and the object's SHA-256."""
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('":'), F.format_string("%.2f", e["value"]))), ","), F.lit("}"))
    return values.groupBy("category").agg(text.alias("snapshot")).withColumn("hash", F.sha2("snapshot", 256))


def rollback(versions: DataFrame, kept: DataFrame) -> DataFrame:
    """Version rows to append so that each key's value in kept(key, value) is active again."""
    return next_version(versions, kept).join(kept, "key").select("key", "next_version", "value", F.lit("active").alias("status"))
