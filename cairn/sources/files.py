"""Real files: directory trees and path lists as entries, and ordered export back to disk or into tar archives."""

from __future__ import annotations

import io
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globbing import Rule, kept_by
from ..scale import numbered


def read_tree(spark: SparkSession, root: str, rules: list[Rule] | None = None, glob: str | None = None) -> DataFrame:
    """Files below ``root``: path (relative, with a leading slash), name, parent, size, mtime, content.  Rules see the relative path.

    Spark's reader leaves out files of no bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.removeprefix("file://").rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), "^" + "".join("\\" + c if c in r".+*?^$()[]{}|\\" else c for c in base), "")
    files = reader.load(root).select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    files = files.withColumns({"name": F.element_at(F.split("path", "/"), -1), "parent": F.regexp_replace("path", "/[^/]*$", "")})
    return files.where(kept_by(F.col("path"), rules)) if rules else files


def read_list(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """Files of a list (path, position): normalised, once each, in the order of first mention; paths outside the root are refused."""
    outside = F.exists(F.split("path", "/"), lambda p: p == "..")
    normal = F.concat(F.lit("/"), F.array_join(F.filter(F.split("path", "/"), lambda p: (p != "") & (p != ".")), "/"))
    checked = paths.select(F.when(outside, F.raise_error(F.concat(F.lit("path outside the root: "), "path"))).otherwise(normal).alias("path"), "position")
    first = numbered(checked.groupBy("path").agg(F.min("position").alias("position")), ["position"], "order_index").drop("position")
    return read_tree(spark, root).join(first, "path")


def extract(files: DataFrame, folder: str, order: str = "path") -> int:
    """Write files (path, content) below a folder that all executors share; the number written.  Directories are made as needed."""

    def write(rows):
        n = 0
        for r in rows:
            at = os.path.normpath(f"{folder}/{r['path']}")
            if not at.startswith(os.path.normpath(folder) + os.sep):
                raise ValueError(f"path outside the folder: {r['path']}")
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(f"{at}.part", "wb") as f:  # a task that is run again replaces what it left
                f.write(r["content"] or b"")
            os.replace(f"{at}.part", at)
            n += 1
        yield n

    return sum(files.select("path", "content").sortWithinPartitions(order).rdd.mapPartitions(write).collect())


def archives(files: DataFrame, shards: int, order: str = "path") -> DataFrame:
    """(shard, archive): tar archives of ranges of the files in order, one for each task."""

    def pack(rows):
        out = io.BytesIO()
        count = 0
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in rows:
                info = tarfile.TarInfo(r["path"].lstrip("/"))
                info.size = len(r["content"] or b"")
                tar.addfile(info, io.BytesIO(r["content"] or b""))
                count += 1
        if count:
            yield (count, out.getvalue())

    parts = files.select("path", "content").repartitionByRange(shards, order).sortWithinPartitions(order)
    return files.sparkSession.createDataFrame(parts.rdd.mapPartitions(pack), "files long, archive binary")
