"""Hashes, segmentation, similarity orders, categorizers and codecs (H, P06, P07, C, Z, R05, R06, S04, S05, K01)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, formats, kernels
from ..operators import requirements, segmenting, similarity
from ..sources.content import CHUNKS, ENTRIES, chunks, entries, table
from .registry import query


def _bytes(spark, d):
    return entries(spark, d).select("ino", "path", "size", F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.split("parent", "/")[1].alias("lang"))


@query("h01_checksums", f"WITH {ENTRIES} SELECT ino, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM e")
def h01(spark, d):
    b = _bytes(spark, d)
    return b.select("ino", *(kernels.checksum(F.col("content"), a).alias(a) for a in ("md5", "sha1", "sha256")))


@query("h01_checksums_more")
def h01_more(spark, d):
    b = _bytes(spark, d)
    return b.select("ino", *(kernels.checksum(F.col("content"), a).alias(a.replace("-", "_")) for a in ("xxh3-64", "xxh3-128", "sha512_256", "blake2b")))


def _mix_sql(x: str) -> str:
    for shift, factor in zip(kernels.MIX_SHIFTS, (*kernels.MIX_FACTORS, 1), strict=True):
        x = f"(xor({x}, ({x}) >> {shift}) * {factor}) & 4294967295"
    return x


@query(
    "h02_word_mix",
    f"WITH w AS (SELECT p_partkey, (p_partkey * 65599 + p_size * 7919 + {kernels.MIX_OFFSET}) & 4294967295 AS x FROM part), m1 AS (SELECT p_partkey, (xor(x, x >> 16) * {kernels.MIX_FACTORS[0]}::HUGEINT) & 4294967295 AS x FROM w), "
    f"m2 AS (SELECT p_partkey, (xor(x, x >> 15) * {kernels.MIX_FACTORS[1]}::HUGEINT) & 4294967295 AS x FROM m1) SELECT p_partkey, CAST(xor(x, x >> 15) >> 24 AS BIGINT) AS bucket FROM m2",
)
def h02_mix(spark, d):
    x = (F.col("p_partkey") * 65599 + F.col("p_size") * 7919 + F.lit(kernels.MIX_OFFSET)).bitwiseAND(F.lit(kernels.MASK))
    return table(spark, d, "part").select("p_partkey", F.shiftright(kernels.mix32(x), 24).alias("bucket"))


@query("h02_similarity_hash")
def h02(spark, d):
    return _bytes(spark, d).select("ino", kernels.similarity_hash("content").alias("hash"))


@query("h03_nilsimsa")
def h03(spark, d):
    return _bytes(spark, d).select("ino", kernels.nilsimsa_words("content").alias("words"))


@query("h04_rolling_hash")
def h04(spark, d):
    @F.pandas_udf(T.LongType())
    def folded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: int(np.bitwise_xor.reduce(kernels.rolling_hashes(b, 64), initial=0)))

    return _bytes(spark, d).select("ino", folded("content").alias("folded"))


@query("h05_bloom_semijoin", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def h05(spark, d):
    keys = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(keys, "l_partkey", "left_semi")


@query("h06_hash_offsets", "SELECT l_partkey % 1000 AS h, count(*) AS n, string_agg(l_orderkey || ':' || l_linenumber || ':' || l_suppkey, ',' ORDER BY l_orderkey, l_linenumber, l_suppkey) AS places FROM lineitem GROUP BY 1")
def h06(spark, d):
    li = table(spark, d, "lineitem")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))), lambda x: F.concat_ws(":", x["l_orderkey"], x["l_linenumber"], x["l_suppkey"])), ",")
    return li.groupBy((F.col("l_partkey") % 1000).alias("h")).agg(F.count("*").alias("n"), listed.alias("places"))


SEGMENTS = segmenting.Config(window_bits=7, shift=1, block_bits=16, lookback=4)


def _ordered(spark, d):
    files = _bytes(spark, d).select(F.col("ino").alias("key"), F.col("lang").alias("category"), F.col("ino").alias("rank"), "size", "content").where("size > 0")
    return segmenting.bucketed(files, "category", ["rank"], "size", 1 << 19)


@query("h07_segment")
def h07(spark, d):
    found, _ = segmenting.segment(_ordered(spark, d), SEGMENTS)
    return found


@query("h07_segment_roundtrip", f"WITH {ENTRIES} SELECT ino AS key, sha256(text) AS digest FROM e WHERE size > 0")
def h07_back(spark, d):
    back = segmenting.reassemble(*segmenting.segment(_ordered(spark, d), SEGMENTS))
    return back.select("key", F.sha2("content", 256).alias("digest"))


@query("h10_granularity", f"WITH {CHUNKS} SELECT file, ord, size // 6 AS frames, size - size % 6 AS aligned FROM c")
def h10(spark, d):
    return chunks(spark, d).select("file", "ord", F.expr("size div 6").alias("frames"), F.expr("size - size % 6").alias("aligned"))


_ESTIMATES = [(w, b, k, g) for w in (0, 10, 12) for b in (20, 24) for k in (0, 1, 3, 4) for g in (1, 6)]


@query(
    "h11_memory_estimate",
    f"""WITH g AS (SELECT w, b, k, g, (1::BIGINT << w) - (1::BIGINT << w) % g AS win, (1::BIGINT << b) // g AS frames FROM (VALUES {", ".join(map(str, _ESTIMATES))}) AS t(w, b, k, g)),
s AS (SELECT *, greatest(win // 2, 1) AS step FROM g), o AS (SELECT *, (frames - (win - step)) // step AS places, k * (frames // step) AS windows FROM s),
f AS (SELECT *, CAST(16 * pow(2, ceil(log2(greatest(windows, 1)))) AS BIGINT) // 8 AS bloom FROM o)
SELECT w AS window_bits, b AS block_bits, k AS lookback, g AS granularity, CASE WHEN w = 0 OR k = 0 THEN 0 ELSE k * (19 * places + CASE WHEN k > 1 THEN bloom ELSE 0 END) + bloom END AS bytes FROM f""",
)
def h11(spark, d):
    rows = [(*r, segmenting.memory_estimate(segmenting.Config(r[0], 1, r[1], r[2], r[3]))) for r in _ESTIMATES]
    return spark.createDataFrame(rows, "window_bits int, block_bits int, lookback int, granularity int, bytes long")


@query("p06_similarity_order")
def p06(spark, d):
    files = _bytes(spark, d).where("size > 0").select("ino", "size", F.coalesce("lang", F.lit("")).alias("part"), kernels.nilsimsa_words("content").alias("words"))
    return similarity.similarity_order(files, "part", "ino", "words", "size")


#: Noise for the recogniser, as the table has none: the first half of each such content is a line again and again.
_NOISE = "concat_ws('', transform(sequence(1, 64), k -> sha2(concat_ws(':', ino, k), 256)))"


@query(
    "c01_incompressible",
    f"""WITH {ENTRIES}, t AS (SELECT ino, strlen(text) AS n FROM e WHERE strlen(text) > 0)
SELECT ino, 'default' AS category, NULL::VARCHAR AS sub, n AS length FROM t UNION ALL SELECT 1000000 + ino, 'incompressible', NULL, 2048 FROM t WHERE ino % 10 = 0
UNION ALL SELECT 2000000 + ino, unnest(['default', 'incompressible']), NULL, 2048 FROM t WHERE ino % 10 = 0""",
)
def c01(spark, d):
    texts = _bytes(spark, d).select("ino", "content")
    noisy = texts.where("ino % 10 = 0 AND length(content) > 0").withColumn("noise", F.unhex(F.expr(_NOISE)))
    alone = noisy.select((F.col("ino") + 1_000_000).alias("ino"), F.col("noise").alias("content"))
    mixed = noisy.select((F.col("ino") + 2_000_000).alias("ino"), F.concat(F.repeat(F.lit("a line of text. "), 128).cast("binary"), "noise").alias("content"))
    # shorter texts hardly shrink whatever they say, so they are not asked
    whole, blocks = (formats.categorized(["incompressible"], block=n, least=2048)("content").alias("f") for n in (1 << 20, 2048))
    return texts.select("ino", whole).unionAll(alone.unionAll(mixed).select("ino", blocks)).select("ino", F.explode("f").alias("f")).select("ino", "f.*")


@query("c02_hotness", f"WITH {ENTRIES} SELECT ino, CASE WHEN ino IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'hotness' ELSE 'default' END AS category FROM e")
def c02(spark, d):
    hot = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("ino")).distinct().withColumn("hot", F.lit(True))
    return entries(spark, d).select("ino").join(hot, "ino", "left").select("ino", F.when(F.col("hot"), "hotness").otherwise("default").alias("category"))


@query("c03_c04_c05_categorize")
def c03(spark, d):
    order = ["pcmaudio", "fits", "binary", "incompressible"]
    return _bytes(spark, d).select("ino", F.explode(formats.categorized(order)("content")).alias("f")).select("ino", "f.*")


@query("c05_magic", "SELECT doc_id, CASE WHEN left(text, 2) = 'An' THEN 'binary/an' WHEN left(text, 3) = 'The' THEN 'binary/the' ELSE 'default' END AS category FROM documents")
def c05(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(t.startswith("An"), "binary/an").when(t.startswith("The"), "binary/the").otherwise("default").alias("category"))


@query("c07_contextual", f"WITH {CHUNKS} SELECT file, ord, CASE category WHEN 'A' THEN 'lzma' WHEN 'N' THEN 'lzma' ELSE 'zstd' END AS codec FROM c")
def c07(spark, d):
    by, default = requirements.parse_contextual(["A,N::lzma", "zstd"])
    return chunks(spark, d).select("file", "ord", requirements.contextual(F.col("category"), by, default).alias("codec"))


@query("c08_subcategories", f"WITH {CHUNKS} SELECT category, block, row_number() OVER (PARTITION BY category ORDER BY block) - 1 AS sub FROM (SELECT DISTINCT category, block FROM c)")
def c08(spark, d):
    from pyspark.sql import Window

    pairs = chunks(spark, d).select("category", "block").distinct()
    return pairs.withColumn("sub", (F.row_number().over(Window.partitionBy("category").orderBy("block")) - 1).cast("long"))


@query("z_codec_roundtrip", f"WITH {ENTRIES}, k AS (SELECT unnest(['brotli', 'lz4', 'lzma', 'null', 'ricepp', 'zstd']) AS codec) SELECT codec, count(*) AS contents, count(*) AS exact FROM e, k GROUP BY codec")
def z_roundtrip(spark, d):
    b = _bytes(spark, d)
    out = None
    for name in ("null", "lz4", "zstd:level=5", "lzma:level=1", "brotli:quality=5", "ricepp"):
        back = codecs.decompressed(codecs.compressed(F.col("content"), name), name)
        one = b.select((back == F.col("content")).alias("same")).agg(F.count("*").alias("contents"), F.count_if("same").alias("exact"))
        one = one.select(F.lit(name.split(":")[0]).alias("codec"), "contents", "exact")
        out = one if out is None else out.unionByName(one)
    return out


@query("z09_keep_raw")
def z09(spark, d):
    return _bytes(spark, d).select("ino", codecs.compressed(F.col("content"), "zstd:level=3").alias("b")).select("ino", "b.codec", F.octet_length("b.payload").cast("long").alias("stored"))


@query("z07_codec_specs", "SELECT * FROM (VALUES ('lzma:level=9:extreme', 'lzma', '9'), ('null', 'null', NULL), ('zstd:level=5', 'zstd', '5')) AS t(spec, codec, level)")
def z07(spark, d):
    rows = [(s, p.name, p.get("level")) for s in ("zstd:level=5", "lzma:level=9:extreme", "null") if (p := codecs.parse(s))]
    return spark.createDataFrame(rows, "spec string, codec string, level string")


@query("z08_codec_ids", "SELECT * FROM (VALUES ('null', 0), ('lzma', 1), ('zstd', 2), ('lz4', 3), ('lz4hc', 4), ('brotli', 5), ('flac', 6), ('ricepp', 7)) AS t(codec, id)")
def z08(spark, d):
    return spark.createDataFrame(list(codecs.IDS.items()), "codec string, id int")


@query("r05_upgrade_shared", f"WITH {ENTRIES}, h AS (SELECT ino, sha256(text) AS h FROM e), g AS (SELECT h, count(*) AS n, min(ino) AS f FROM h GROUP BY h) SELECT ino, row_number() OVER (ORDER BY n > 1, f, ino) - 1 AS renumbered FROM h JOIN g USING (h)")
def r05(spark, d):
    from ..scale import numbered

    e = _bytes(spark, d).select("ino", F.sha2("content", 256).alias("h"))
    g = e.groupBy("h").agg(F.count("*").alias("n"), F.min("ino").alias("f"))
    return numbered(e.join(g, "h").select("ino", (F.col("n") > 1).alias("shared"), "f"), ["shared", "f", "ino"], "renumbered").select("ino", "renumbered")


@query("r06_recompress", f"WITH {ENTRIES} SELECT ino, parent LIKE '/en%' AS recompressed, sha256(text) AS digest FROM e")
def r06(spark, d):
    b = _bytes(spark, d).withColumn("block", codecs.compressed(F.col("content"), "zstd:level=1"))
    chosen = requirements.selected_categories(F.col("lang"), "en")
    again = codecs.compressed(codecs.decompressed(F.col("block"), "zstd:level=1"), "brotli:quality=4")
    new = b.where(chosen).select("ino", F.lit(True).alias("recompressed"), codecs.decompressed(again, "brotli:quality=4").alias("back"))
    old = b.where(~chosen).select("ino", F.lit(False).alias("recompressed"), codecs.decompressed(F.col("block"), "zstd:level=1").alias("back"))
    return new.unionByName(old).select("ino", "recompressed", F.sha2("back", 256).alias("digest"))


@query("s05_find_container", "SELECT doc_id, CAST(doc_id % 13 AS BIGINT) AS found, sha256(text) AS digest FROM documents")
def s05(spark, d):
    """Containers behind a header of some bytes, found and read back."""

    @F.pandas_udf(T.BinaryType())
    def wrap(ids: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([b"x" * (i % 13) + formats.section(0, 1, c) + formats.section(1, 2, b"end") for i, c in zip(ids, content, strict=True)])

    @F.pandas_udf(T.StructType([T.StructField("found", T.LongType()), T.StructField("payload", T.BinaryType())]))
    def unwrap(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"found": [formats.find_container(r) for r in raw], "payload": [formats.read_sections(r)[0][2] for r in raw]})

    b = table(spark, d, "documents").select("doc_id", wrap("doc_id", F.col("text").cast("binary")).alias("raw")).select("doc_id", unwrap("raw").alias("u"))
    return b.select("doc_id", "u.found", F.sha2("u.payload", 256).alias("digest"))


@query("s04_k01_sections", "SELECT source, count(*) AS sections, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY source")
def s04(spark, d):
    """Sections written in order, partitioned by kind, and read back with pruning."""
    from ..sources.sections import read_sections, write_sections

    s = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.col("source").alias("kind"), F.col("text").cast("binary").alias("payload"))
    back = read_sections(spark, write_sections(s), ["src1", "src2", "src3"])
    return back.groupBy(F.col("kind").alias("source")).agg(F.count("*").alias("sections"), F.sum("length").alias("bytes"))
