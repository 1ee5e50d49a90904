"""The test tables as a content store: entries, a path tree, chunks, an access trace, bit vectors.

The SQL of each view is given beside it, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Modes that entries take in turn.
MODES = [0o100644, 0o100600, 0o100755, 0o100444]


#: Rows of an Arrow batch at most: contents are long, and a Python worker holds a batch several times over.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: ino, path, parent, name, size in bytes, text, mode, uid, gid."""
    d = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    parent = F.concat(F.lit("/"), "lang", F.lit("/"), "source")
    return d.select(
        F.col("doc_id").alias("ino"), F.concat(parent, F.lit("/"), name).alias("path"), parent.alias("parent"), name.alias("name"), F.octet_length("text").cast("long").alias("size"), "text",
        F.element_at(F.array(*map(F.lit, MODES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("mode"), (1000 + F.col("doc_id") % 3).alias("uid"), (100 + F.col("doc_id") % 2).alias("gid"),
    )


ENTRIES = (
    "e AS (SELECT doc_id AS ino, '/' || lang || '/' || source || '/' || doc_id AS path, '/' || lang || '/' || source AS parent, CAST(doc_id AS VARCHAR) AS name, strlen(text) AS size, text, "
    f"({MODES})[1 + doc_id % 4] AS mode, 1000 + doc_id % 3 AS uid, 100 + doc_id % 2 AS gid FROM documents)"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the chunks of a file: file, ord, size, hole, block, category, offset (before it in the file)."""
    li = table(spark, sf_dir, "lineitem")
    by_file = Window.partitionBy("file").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    c = li.withColumn("file", F.col("l_orderkey")).select(
        "file", (F.row_number().over(by_file) - 1).cast("long").alias("ord"), F.col("l_quantity").cast("long").alias("size"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("hole"),
        (F.col("l_suppkey") % 5).alias("block"), F.col("l_returnflag").alias("category"),
    )
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


CHUNKS = (
    "c0 AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS ord, CAST(l_quantity AS BIGINT) AS size, "
    "l_linestatus = 'O' AND l_returnflag = 'N' AS hole, l_suppkey % 5 AS block, l_returnflag AS category FROM lineitem), "
    'c AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c0)'
)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as paths: page_id, path (host and path components, no query or fragment), and its bytes' size."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    return p.select("page_id", F.concat(F.lit("/"), F.regexp_replace(bare, "/+$", "")).alias("path"), F.octet_length("html").cast("long").alias("size"))


TREE = "t AS (SELECT page_id, '/' || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/+$', '') AS path, strlen(html) AS size FROM pages)"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of the embeddings as one long."""
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits"), "label")


VECTORS = (
    "v AS (SELECT vec_id, CAST(list_reduce(list_transform(embedding[2:], lambda x: CASE WHEN x > 0 THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda a, x: a * 2 + x, "
    "CASE WHEN embedding[1] > 0 THEN -1::HUGEINT ELSE 0::HUGEINT END) AS BIGINT) AS bits, label FROM embeddings)"
)
