"""Shared plumbing: tables, lineage cuts, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table (a long and a few bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch at most: texts are long, and a batch is in memory several times on its way through Python.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process and the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spill(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Files are dealt by the columns ``parts``, so that a filter on these reads only what it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column has; Spark's names know no case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, row: str) -> DataFrame:
    """``df`` as a table with ``row``, an id of each row that is written once and so stays as it is, whatever doc_ids are."""
    return spill(df.withColumn(row, F.monotonically_increasing_id()), name)


def forget(df: DataFrame) -> None:
    """Delete the files behind a spilled table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a spilled table of keys) with a broadcast hint if it has at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def residue(column: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; a null is an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A ``mapInArrow`` function that applies ``fn`` to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together (one text at least), to bound temporary arrays."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
