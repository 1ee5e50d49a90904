"""Integrity and consistency checks as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_sections(sections: DataFrame) -> DataFrame:
    """Sections with ``intact``: whether the SHA-256 of the payload is the stored digest."""
    return sections.withColumn("intact", F.sha2("payload", 256).eqNullSafe(F.col("digest")))


#: Kinds of which an image may hold several sections.
MANY = ("block", "history")


def section_errors(sections: DataFrame, level: str = "checksum") -> DataFrame:
    """(error, number) of sections (number, kind, payload, fast, digest) at a level.

    ``checksum`` compares the fast digest (64-bit xxHash), ``integrity`` and ``full`` the SHA-256; ``full`` belongs with
    ``metadata.consistency``.  Of a kind that must be single each damage-free section after the first by number is a duplicate, as one that is
    damaged is an error already.
    """
    if level not in ("checksum", "integrity", "full"):
        raise ValueError(f"no such level: {level}")
    sound = F.xxhash64("payload").eqNullSafe(F.col("fast")) if level == "checksum" else F.sha2("payload", 256).eqNullSafe(F.col("digest"))
    checked = sections.select("number", "kind", sound.alias("sound"))
    single = checked.where(F.col("sound") & ~F.col("kind").isin(*MANY))
    first = single.groupBy("kind").agg(F.min("number").alias("_first"))
    repeated_kinds = single.join(first, "kind").where("number > _first").select(F.lit("duplicate").alias("error"), "number")
    return checked.where(~F.col("sound")).select(F.lit("damaged").alias("error"), "number").unionByName(repeated_kinds)


def dangling(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Ids of rows whose key no target has."""
    return rows.join(targets.select(key).distinct(), key, "left_anti").select("id")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).count().where("count > 1").select("id")


def violations(found: dict[str, DataFrame]) -> DataFrame:
    """One table (rule, id) of all checks."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(rule).alias("rule"), F.col("id").cast("long").alias("id")) for rule, df in found.items()))


def mismatches(cached: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose cached value is not the actual one, or that only one side has."""
    both = cached.select(key, F.col(value).alias("cached")).join(actual.select(key, F.col(value).alias("actual")), key, "full")
    return both.where(~F.col("cached").eqNullSafe(F.col("actual")))
