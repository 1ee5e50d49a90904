"""The info report: fields by level of detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The level from which each part is reported.
LEVELS = {"summary": 1, "chunks": 2, "categories": 3}


def info_report(entries: DataFrame, chunks: DataFrame, level: int = 3) -> DataFrame:
    """(field, value) rows of all parts up to a level."""

    def rows(df: DataFrame, *names: str) -> DataFrame:
        return df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("long").alias("value")) for n in names))))

    parts = {
        "summary": lambda: rows(entries.agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size")), "file_count", "total_size"),
        "chunks": lambda: rows(chunks.agg(F.count("*").alias("chunk_count"), F.sum(F.when(F.col("hole"), F.col("size"))).alias("hole_size")), "chunk_count", "hole_size"),
        "categories": lambda: chunks.groupBy("category").agg(F.sum("size").alias("value")).select(F.concat(F.lit("category_"), "category").alias("field"), "value"),
    }
    return reduce(DataFrame.unionByName, (make() for name, make in parts.items() if LEVELS[name] <= level))
