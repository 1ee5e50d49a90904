"""Byte-range reads and data/hole seeks over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranges(parts: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, bytes) of requests (file, start, length) on parts (file, offset, part): overlapping parts, cut and joined in order.

    A request at or past the end gives no row; a negative start is an error.
    """
    asked = requests.withColumn("start", F.when(F.col("start") >= 0, F.col("start")).otherwise(F.raise_error(F.lit("negative offset"))))
    hit = parts.join(asked, "file").where("offset < start + length AND offset + length(part) > start")
    low = F.greatest(F.col("start") - F.col("offset"), F.lit(0)).cast("int")
    high = F.least(F.col("start") + F.col("length") - F.col("offset"), F.length("part")).cast("int")
    cut = hit.select("file", F.struct("offset", F.substring(F.col("part"), low + 1, high - low).alias("bytes")).alias("x"))
    return cut.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bytes"]), "").alias("bytes"))


def seek(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, start, data, hole): the next data and the next hole at or after ``start``; a file ends in a hole, and past its end there is nothing."""
    ends = chunks.groupBy("file").agg(F.sum("size").alias("total"))
    at = F.when(F.col("size") > 0, F.when(F.col("offset") + F.col("size") > F.col("start"), F.greatest("offset", "start")))
    found = chunks.join(requests, "file").groupBy("file", "start").agg(F.min(F.when(~F.col("hole"), at)).alias("data"), F.min(F.when(F.col("hole"), at)).alias("hole"))
    return found.join(ends, "file").where("start < total").select("file", "start", "data", F.coalesce("hole", "total").alias("hole"))
