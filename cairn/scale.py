"""Helpers for plans that must hold at any size: global order without a single task, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``_part``: rows dealt by range of ``order``, so parts are in order and each fits a task."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, order: list, sums: dict[str, object], inclusive: bool = True) -> DataFrame:
    """Running sums over a total order, as sums within ranges plus the sums of the ranges before.

    ``sums`` names new columns and what they add up.  Only one row for each range is ordered in one task.
    """
    parts = ranged(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), order)
    totals = parts.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = parts.join(F.broadcast(offsets), "_part")
    out = out.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) + F.col(f"_o_{k}") for k in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without one task for all."""
    return running(df, order, {name: F.lit(1).cast("long")}, inclusive=False)


def lagged(df: DataFrame, value: str, order: list, name: str, default=0) -> DataFrame:
    """The value one row before in a total order; the last value of each range reaches the next by a small join."""
    parts = ranged(df, order)
    within = Window.partitionBy("_part").orderBy(*order)
    last = parts.groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select("_part", F.lag("_last", 1).over(Window.orderBy("_part")).alias("_carried"))
    out = parts.join(F.broadcast(carried), "_part").withColumn("_first", F.row_number().over(within) == 1)
    out = out.withColumn(name, F.coalesce(F.when(F.col("_first"), F.col("_carried")).otherwise(F.lag(value, 1).over(within)), F.lit(default)))
    return out.select(*df.columns, name)


def first_from(df: DataFrame, group: str, at: str, id: str, back: int, name: str) -> DataFrame:
    """(group, at, id) with ``name``: the first (at, id) of the group that is no more than ``back`` before the row.

    A window over a range looks at all its rows for each row.  Here rows and the starts of their windows are one order,
    and each start meets the next row in it: one sort, dealt by range, whatever the windows hold.
    """
    found = F.struct(F.col(at), F.col(id))
    rows = df.select(group, at, id, F.col(at).alias("_k"), F.lit(1).alias("_row"))
    starts = df.select(group, at, id, (F.col(at) - F.lit(back)).alias("_k"), F.lit(0).alias("_row"))
    order = [group, "_k", "_row", id]
    parts = ranged(rows.unionByName(starts), order)
    own = F.when(F.col("_row") == 1, found)
    falling = [F.desc(c) for c in order]
    # rows before (unbounded, current) in falling order are the rows from here on; a frame that starts here would be summed anew for each row
    here = F.last(own, ignorenulls=True).over(Window.partitionBy("_part").orderBy(*falling).rowsBetween(Window.unboundedPreceding, 0))
    least = parts.where("_row = 1").groupBy("_part").agg(F.min_by(found, F.struct(*order)).alias("_least"))
    every = parts.select("_part").distinct().join(least, "_part", "left")
    later = F.last("_least", ignorenulls=True).over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("_here", here).where("_row = 0").join(F.broadcast(every.select("_part", later.alias("_later"))), "_part")
    return out.select(group, at, id, F.coalesce("_here", "_later").alias(name))
