"""Bit vectors by Hamming distance: joins by banded keys, centroids, path length."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lagged


def distance(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def flips(width: int, most: int) -> list[int]:
    """Masks of all ways to change at most ``most`` of ``width`` bits."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(width), n)]


#: Vectors of a block at most, about: two blocks are compared in one task, in 2**28 steps of some nanoseconds.
BLOCK = 1 << 14
#: Pairs that are compared at once; their differences stay in a core's cache.
STEP = 1 << 17


def close_pairs(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a``, places in ``b`` and distances of the pairs of vectors at most ``most`` bits apart."""
    rows = max(1, STEP // max(len(b), 1))
    left, right, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), rows):
        d = np.bitwise_count(a[at : at + rows, None] ^ b)
        i, j = np.nonzero(d <= most)
        if len(i):
            left.append(i + at)
            right.append(j)
            far.append(d[i, j].astype(np.int64))
    return np.concatenate(left), np.concatenate(right), np.concatenate(far)


def _blocked(df: DataFrame, other: DataFrame, most: int, key: str, bits: str, block: int) -> DataFrame:
    """All pairs, by pairs of blocks: each vector goes to a group for every block of the other side."""
    df, other = (x.select(F.col(key).alias("key"), F.col(bits).alias("bits")).where("bits IS NOT NULL") for x in (df, other))
    kind = df.schema["key"].dataType.simpleString()
    n, m = (max(1, -(-x.count() // block)) for x in (df, other))

    def dealt(rows: DataFrame, own: str, blocks: int, across: str, others: int, second: bool) -> DataFrame:
        of = F.pmod(F.xxhash64("key", "bits", F.lit(second)), F.lit(blocks)).cast("int")
        return rows.select("key", "bits", F.lit(second).alias("second"), of.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(across))

    def compare(group: pa.Table) -> pa.Table:
        second = group["second"].to_numpy()
        sides = [group.filter(pa.array(second == s)) for s in (False, True)]
        i, j, d = close_pairs(*(x["bits"].to_numpy().astype(np.int64).view(np.uint64) for x in sides), most)
        return pa.table({"a": sides[0]["key"].take(pa.array(i)), "b": sides[1]["key"].take(pa.array(j)), "distance": pa.array(d, pa.int64())})

    both = dealt(df, "i", n, "j", m, False).unionByName(dealt(other, "j", m, "i", n, True))
    # a number of its own, as groups are small and slow: merged by their bytes they would be a few long tasks
    return both.repartition(min(n * m, 4096), "i", "j").groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, distance long")


def within(df: DataFrame, other: DataFrame, most: int, key: str = "vec_id", bits: str = "bits", block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, distance) at most ``most`` bits apart.

    Of a few segments of a vector's bits one differs in at most its share of ``most``.  So the vectors of ``other`` are
    indexed by each segment with that many bits changed in every way, and an equality join finds all pairs; segments
    have 16 bits or more, so keys tell vectors apart.  Where more than one bit of a segment may change, a vector would
    have hundreds or thousands of keys, which cost more than to compare all pairs of blocks; so that is done.
    The join is never by broadcast: the planner knows a vector's size, but not how many keys it has.
    """
    parts = min(most + 1, 4)
    if most // parts > 1:
        return _blocked(df, other, most, key, bits, block)
    width = 64 // parts
    changed = flips(width, most // parts)
    low = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    cut = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(bits), k * width).bitwiseAND(low).alias("p")) for k in range(parts)))
    left = df.select(F.col(key).alias("a"), F.col(bits).alias("va"), F.explode(cut).alias("segment"))
    right = other.select(F.col(key).alias("b"), F.col(bits).alias("vb"), F.explode(cut).alias("s"))
    if most // parts:
        right = right.select("b", "vb", "s", F.explode(F.lit(changed).cast("array<long>")).alias("m"))
        right = right.select("b", "vb", F.struct(F.col("s.k").alias("k"), F.col("s.p").bitwiseXOR(F.col("m")).alias("p")).alias("segment"))
    else:
        right = right.withColumnRenamed("s", "segment")
    near = left.hint("merge").join(right.hint("merge"), "segment").where(distance("va", "vb") <= most)
    return near.select("a", "b", distance("va", "vb").cast("long").alias("distance")).distinct()


def centroid(df: DataFrame, group: str, bits: str = "bits", width: int = 64) -> DataFrame:
    """Bits set in over half of a group's vectors (half rounded down)."""
    counts = [F.sum(F.shiftrightunsigned(F.col(bits), k).bitwiseAND(F.lit(1).cast("long"))).alias(f"_{k}") for k in range(width)]
    c = df.groupBy(group).agg(F.count("*").alias("n"), *counts)
    out = F.lit(0).cast("long")
    for k in range(width):
        one = F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
        out = out.bitwiseOR(F.when(F.col(f"_{k}") > F.floor(F.col("n") / 2), one).otherwise(F.lit(0).cast("long")))
    return c.select(group, "n", out.alias("centroid"))


def path_length(df: DataFrame, order: list[str], bits: str = "bits") -> DataFrame:
    """Sum of the distances of neighbours in an order."""
    before = lagged(df, bits, order, "_before", default=None)
    return before.agg(F.coalesce(F.sum(F.bit_count(F.col(bits).bitwiseXOR(F.col("_before")))), F.lit(0)).cast("long").alias("total_distance"))
