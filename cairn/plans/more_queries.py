"""Operators that the other modules use as parts, each on its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, rice
from ..operators import segmenting, similarity
from ..sources.content import CHUNKS, ENTRIES, chunks, entries, table, vectors
from .kernel_queries import SEGMENTS, _bytes, _ordered
from .registry import query


@query("k01_k02_section_digests", "SELECT source AS kind, count(*) AS sections, count(*) AS intact FROM documents GROUP BY source")
def k01(spark, d):
    from ..operators.checking import check_sections
    from ..sources.sections import read_sections, write_sections

    s = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.col("source").alias("kind"), F.col("text").cast("binary").alias("payload"))
    return check_sections(read_sections(spark, write_sections(s))).groupBy("kind").agg(F.count("*").alias("sections"), F.count_if("intact").alias("intact"))


@query("k04_header_copy", "SELECT doc_id, 'head' || chr(10) AS header, strlen(text) + 5 AS size FROM documents")
def k04(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.lit("head\n").alias("header"), (F.octet_length("text") + F.octet_length(F.lit("head\n"))).cast("long").alias("size"))


@query("s07_load_metadata", f"WITH {CHUNKS} SELECT file, count(*) AS chunks FROM c GROUP BY file")
def s07(spark, d):
    """Chunks written as a metadata table and loaded with a fixed schema."""
    from ..scale import written

    return written(chunks(spark, d)).groupBy("file").agg(F.count("*").alias("chunks"))


@query("s10_legacy_versions", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_custkey ELSE o_custkey + 1 END AS content_ix FROM orders")
def s10(spark, d):
    """Rows of two format versions: the older one counts contents from one."""
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("content_ix"))


@query("h08_h12_segment_stats")
def h12(spark, d):
    found, blocks = segmenting.segment(_ordered(spark, d), SEGMENTS)
    stored = blocks.groupBy("category").agg(F.sum("size").alias("stored"), F.count("*").alias("blocks"))
    return found.groupBy("category").agg(F.sum("size").alias("referenced"), F.count("*").alias("chunks")).join(stored, "category")


@query("h09_constant_windows")
def h09(spark, d):
    """Window hashes of one repeated byte, of which the index keeps one a block."""
    from ..functions.kernels import constant_hash, rolling_hashes

    hashes = np.array(sorted({constant_hash(b, 64) for b in range(256)}), np.int64)

    def count(b: bytes, run: int = 1 << 16) -> int:
        # a window's hash does not depend on its place, so a long content is hashed by runs of windows
        return sum(int(np.isin(rolling_hashes(b[at : at + run + 63], 64), hashes).sum()) for at in range(0, len(b) - 63, run))

    @F.pandas_udf(T.LongType())
    def constant(content: pd.Series) -> pd.Series:
        return content.map(count)

    return _bytes(spark, d).select("ino", constant("content").alias("constant_windows"))


@query("p07_greedy_order")
def p07(spark, d):
    """Greedy nearest neighbours of the vectors of a label."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id").reset_index(drop=True)
        order = similarity.greedy(rows["bits"].to_numpy(np.int64).view(np.uint64)[:, None])
        return pd.DataFrame({"label": rows["label"].iloc[0], "vec_id": rows["vec_id"].to_numpy()[order], "position": range(len(rows))})

    return vectors(spark, d).groupBy("label").applyInPandas(run, "label int, vec_id long, position long")


@query("v17_option_string", "SELECT p_partkey, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, p_type, NULL FROM part")
def v17(spark, d):
    text = F.concat(F.lit("size="), F.col("p_size").cast("string"), F.lit(","), "p_type")
    return table(spark, d, "part").select("p_partkey", F.explode(F.str_to_map(text, F.lit(","), F.lit("="))).alias("key", "value"))


@query("z06_rice_blocks", f"WITH {ENTRIES} SELECT ino, true AS exact FROM e")
def z06(spark, d):
    @F.pandas_udf(T.BooleanType())
    def exact(content: pd.Series) -> pd.Series:
        return content.map(lambda b: rice.decode(rice.encode(b)) == b)

    return _bytes(spark, d).select("ino", exact("content").alias("exact"))


@query("z10_presets", "SELECT * FROM (VALUES (0, 'null', 20, 0), (1, 'lz4', 20, 0), (2, 'lz4hc:level=9', 20, 0), (3, 'zstd:level=4', 21, 12), (4, 'zstd:level=11', 22, 12), (5, 'zstd:level=16', 23, 12), (6, 'zstd:level=20', 24, 12), (7, 'zstd:level=22', 24, 12), (8, 'lzma:level=8', 24, 12), (9, 'lzma:level=9', 26, 12)) AS t(level, codec, block_bits, window_bits)")
def z10(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in codecs.PRESETS.items()], "level int, codec string, block_bits int, window_bits int")


@query("z11_dictionary_if_smaller", "WITH t AS (SELECT 'p_name' AS field, sum(strlen(p_name)) AS raw, (SELECT sum(strlen(n)) FROM (SELECT DISTINCT p_name AS n FROM part)) + count(*) AS packed FROM part) SELECT field, CAST(raw AS BIGINT) AS raw, CAST(least(raw, packed) AS BIGINT) AS stored FROM t")
def z11(spark, d):
    """A string table is kept as a dictionary with one-byte indices only if that is smaller."""
    p = table(spark, d, "part")
    raw = p.agg(F.sum(F.octet_length("p_name")).alias("raw"), F.count("*").alias("n"))
    words = p.select("p_name").distinct().agg(F.sum(F.octet_length("p_name")).alias("words"))
    return raw.join(words).select(F.lit("p_name").alias("field"), "raw", F.least("raw", F.col("words") + F.col("n")).alias("stored"))  # one row each


@query("z12_pcm_samples", f"WITH {ENTRIES} SELECT ino, true AS exact FROM e")
def z12(spark, d):
    @F.pandas_udf(T.BooleanType())
    def exact(content: pd.Series) -> pd.Series:
        def same(b: bytes) -> bool:
            b = b[: len(b) - len(b) % 2]
            v = codecs.unpack_samples(b, 16, 2, True, True, False)
            return codecs.pack_samples(v, 16, 2, True, True, False) == b

        return content.map(same)

    return entries(spark, d).select("ino", exact(F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


@query("t08_progress_counters", f"WITH {ENTRIES} SELECT count(*) AS files_scanned, CAST(sum(size) AS BIGINT) AS bytes_scanned FROM e")
def t08(spark, d):
    """Counters observed while a plan runs, as a row."""
    from pyspark.sql import Observation

    seen = Observation()
    e = entries(spark, d).observe(seen, F.count("*").alias("files_scanned"), F.sum("size").alias("bytes_scanned"))
    e.select("ino", "size").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["files_scanned"], seen.get["bytes_scanned"])], "files_scanned long, bytes_scanned long")
