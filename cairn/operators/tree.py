"""Paths as trees: ancestors, pruning, orders, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column, itself: bool = False) -> Column:
    """All proper prefixes of an absolute path that end at a component; with ``itself``, the path too."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.size(parts) - (0 if itself else 1)
    return F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """Files and all their directories: path, is_dir, depth, parent, name."""
    dirs = files.select(F.explode(ancestors(F.col(path))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    found = dirs.unionByName(files.select(F.col(path).alias("path")).distinct().join(dirs.select("path"), "path", "left_anti").withColumn("is_dir", F.lit(False)))
    return found.select("path", "is_dir", depth(F.col("path")).alias("depth"), parent(F.col("path")).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"))


def prune(entries: DataFrame, kept: Column, path: str = "path") -> DataFrame:
    """Entries that are kept and none of whose ancestors is dropped: what lies below a dropped directory is never visited."""
    dropped = entries.where(~kept).select(F.col(path).alias("_dropped"))
    up = entries.where(kept).select(path, F.explode(ancestors(F.col(path))).alias("_dropped"))
    below = up.join(dropped, "_dropped", "left_semi").select(path).distinct()
    return entries.where(kept).join(below, path, "left_anti")


def without_empty_dirs(entries: DataFrame) -> DataFrame:
    """Files, and directories that hold a file at some depth."""
    files = entries.where(~F.col("is_dir"))
    holding = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return entries.join(holding, "path", "left_semi").where("is_dir").unionByName(files)


def reverse_path(path: Column) -> Column:
    """Sort key by leaf name first, then parent and so on; of equal chains the shorter comes first."""
    return F.reverse(F.split(F.substring(path, F.lit(2), F.length(path)), "/"))


def walk_key(path: Column) -> Column:
    """Sort key of a preorder walk with names in byte order."""
    return F.split(path, "/")
