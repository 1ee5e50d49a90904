"""Ordered sequences: deltas, runs, dictionaries, intervals, chunk offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import lagged, numbered, running


def delta_encode(df: DataFrame, value: str, order: list[str], name: str = "delta") -> DataFrame:
    """Differences of neighbours in a total order; the first value is kept."""
    return lagged(df, value, order, "_before").withColumn(name, F.col(value) - F.col("_before")).drop("_before")


def delta_decode(df: DataFrame, delta: str, order: list[str], name: str = "value") -> DataFrame:
    return running(df, order, {name: F.col(delta)})


def pack_runs(df: DataFrame, value: str) -> DataFrame:
    """Values that occur twice or more, in order, as their run length less two."""
    return df.groupBy(value).agg((F.count("*") - 2).alias("packed")).where("packed >= 0")


def unpack_runs(packed: DataFrame, ix: str, run: str) -> DataFrame:
    """Each index as often as its packed run says, plus two."""
    return packed.select(ix, F.explode(F.sequence(F.lit(0).cast("long"), F.col(run) + 1)).alias("copy"))


def sorted_dictionary(df: DataFrame, value: str, name: str = "ix") -> DataFrame:
    """Distinct values and their rank from 0.  Only distinct values are ordered."""
    return numbered(df.select(value).distinct(), [value], name)


def first_seen_dictionary(df: DataFrame, value: str, position: str, name: str = "ix") -> DataFrame:
    """Distinct values numbered by their first position."""
    return numbered(df.groupBy(value).agg(F.min(position).alias("_first")), ["_first", value], name).drop("_first")


def islands(df: DataFrame, within: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows between breaks inside each group."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("_b", breaks.cast("long")).withColumn(name, F.sum("_b").over(w)).drop("_b")


def merge_adjacent(chunks: DataFrame) -> DataFrame:
    """Neighbouring chunks of a file that continue each other in one block become one: file, ord (first), block, offset, size, parts."""
    w = Window.partitionBy("file").orderBy("ord")
    follows = (F.lag("block").over(w) == F.col("block")) & (F.lag(F.col("block_offset") + F.col("size")).over(w) == F.col("block_offset"))
    runs = islands(chunks.withColumn("_follows", F.coalesce(follows, F.lit(False))), ["file"], ["ord"], ~F.col("_follows"))
    return runs.groupBy("file", "island").agg(F.min("ord").alias("ord"), F.first("block").alias("block"), F.min("block_offset").alias("block_offset"), F.sum("size").alias("size"), F.count("*").alias("parts")).drop("island")


def overlaps(ranges: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Ranges cut to [low, high): those that share a byte with it, with ``cut_start`` and ``cut_end``."""
    return ranges.withColumns({"cut_start": F.greatest(F.col(start), low), "cut_end": F.least(F.col(end), high)}).where("cut_start < cut_end")


def intersect_ranges(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Common parts of two sets of ranges (key, start, stop); the ranges of one set do not overlap each other."""
    right = b.select(key, F.col("start").alias("_s"), F.col("stop").alias("_e"))
    both = a.join(right, key).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("stop")))
    return both.select(key, F.greatest("start", "_s").alias("start"), F.least("stop", "_e").alias("stop"))


def complement_ranges(ranges: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """What the ranges (key, start, stop) leave of [0, size): gaps before each and after the last."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    tail = sizes.select(key, F.col("size").alias("start"), F.col("size").alias("stop"))
    bounded = ranges.select(key, "start", "stop").unionByName(tail)
    gap = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bounded.select(key, gap.alias("_gap"), F.col("start").alias("stop")).where("_gap < stop").select(key, F.col("_gap").alias("start"), "stop")
