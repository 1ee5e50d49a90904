"""Exact deduplication that hashes no more than it must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collision_candidates(files: DataFrame, size: str = "size", content: str = "text", prefix_from: int = 1 << 20, prefix: int = 4096) -> DataFrame:
    """Files that share their size (and, when large, a hash of their first bytes) with another one.

    The groups are counted with map-side combination, so no group of files is gathered.
    """
    large = F.col(size) >= prefix_from
    keyed = files.withColumn("_prefix", F.when(large, F.xxhash64(F.substring(F.col(content).cast("binary"), F.lit(1), F.lit(prefix)))).otherwise(F.lit(0)))
    shared = keyed.groupBy(size, "_prefix").count().where("count > 1").drop("count")
    return keyed.join(shared, [size, "_prefix"], "left_semi").drop("_prefix")


def content_groups(files: DataFrame, key: str = "path", size: str = "size", content: str = "text") -> DataFrame:
    """One row for each content that occurs more than once: digest, size, copies, first key.  Only size collisions are hashed."""
    hashed = collision_candidates(files, size, content).withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.groupBy("digest").agg(F.first(size).alias("size"), F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def savings(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_files"), F.coalesce(F.sum((F.col("copies") - 1) * F.col("size")), F.lit(0)).cast("long").alias("saved_by_deduplication")
    )


def first_in_group(keys: list[str], order: str, name: str) -> Column:
    return F.min(order).over(Window.partitionBy(*keys)).alias(name)
