"""Sections of an image as a Parquet table, partitioned by kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import shared_folder

SCHEMA = "number long, length long, digest string, payload binary, kind string"


def write_sections(sections: DataFrame, path: str | None = None) -> str:
    """Write (number, kind, payload) with length and digest, ordered by number within files; gives the path."""
    if path is None:
        path = f"{shared_folder(sections.sparkSession)}/cairn-sections-{uuid.uuid4().hex}"
    rows = sections.select("number", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest"), "payload", "kind")
    # by range of (kind, number), so that a kind of many sections is many files
    rows.repartitionByRange("kind", "number").sortWithinPartitions("kind", "number").write.partitionBy("kind").parquet(path)
    return path


def read_sections(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(SCHEMA).parquet(path)
    return df.where(F.col("kind").isin(*kinds)) if kinds else df
