"""Chunks into blocks: packing without search, repacking to another block size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import ranged


def stream_offsets(chunks: DataFrame, stream: str, order: list[str], size: str = "size") -> DataFrame:
    """``low`` and ``high`` of each chunk in its stream, laid end to end in order.

    Sums run within ranges of (stream, order) and the ranges' sums are added, so a stream of any length is no single task.
    """
    parts = ranged(chunks, [stream, *order])
    totals = parts.groupBy("_part", stream).agg(F.sum(size).alias("_t"))
    before = Window.partitionBy(stream).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", stream, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_part", stream).orderBy(*order)
    out = parts.join(offsets, ["_part", stream])
    out = out.withColumn("high", F.sum(size).over(within) + F.col("_o"))
    return out.withColumn("low", F.col("high") - F.col(size)).drop("_part", "_o")


def repacked(chunks: DataFrame, stream: str, order: list[str], block_size: int, size: str = "size") -> DataFrame:
    """Chunks cut at the ends of blocks of ``block_size``: block (of the stream), offset in it, size, and ``part_of`` the original size."""
    laid = stream_offsets(chunks.where(F.col(size) > 0), stream, order, size)
    blocks = F.sequence(F.floor(F.col("low") / block_size), F.floor((F.col("high") - 1) / block_size))
    cut = laid.withColumn("part_of", F.col(size)).select(*[c for c in laid.columns if c not in (size, "block", "offset")], "part_of", F.explode(blocks).alias("block"))
    start, stop = F.greatest(F.col("low"), F.col("block") * block_size), F.least(F.col("high"), (F.col("block") + 1) * block_size)
    return cut.withColumns({"offset": start - F.col("block") * block_size, size: stop - start})


def hole_codes(holes: DataFrame, block_size: int, size: str = "size") -> DataFrame:
    """Sizes of holes as (chunk_size, chunk_offset) of the hole block: blocks and rest, if both fit 32 bits, else an index of large sizes.

    A large size has the fixed mark 0xFFFFFFFF as offset and its place among the distinct large sizes as size.
    """
    fits = F.floor(F.col(size) / block_size) < 0xFFFFFFFF
    small = holes.where(fits).withColumns({"chunk_size": F.floor(F.col(size) / block_size), "chunk_offset": F.col(size) % block_size})
    from .sequences import first_seen_dictionary

    large = holes.where(~fits)
    table = first_seen_dictionary(large, size, "ord", "chunk_size")
    return small.unionByName(large.join(table, size).withColumn("chunk_offset", F.lit(0xFFFFFFFF).cast("long")))
