"""Mergeable summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import running


def exact_quantiles(df: DataFrame, group: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Least values that at least a share ``p`` of a group does not exceed, by name.

    Values are counted first, and the counts of all groups are summed in one order dealt by range, so neither a group
    nor its distinct values meet in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    summed = running(counts, [group, value], {"_upto": F.col("_n")})
    groups = summed.groupBy(group).agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_all"))
    ranked = summed.join(groups, group)
    share = F.col("_upto") - F.col("_before")
    return ranked.groupBy(group).agg(*(F.min(F.when(share >= F.lit(p) * F.col("_all"), F.col(value))).alias(name) for name, p in probabilities.items()))


def quantile_sketch(df: DataFrame, group: str, value: str, probabilities: list[float]) -> DataFrame:
    """Approximate quantiles of a group by KLL sketches, which combine before the shuffle."""
    sketch = df.groupBy(group).agg(F.expr(f"kll_sketch_agg_bigint({value})").alias("sketch"))
    return sketch.select(group, *(F.expr(f"kll_sketch_get_quantile_bigint(sketch, {p}D)").alias(f"p{round(100 * p)}") for p in probabilities))
