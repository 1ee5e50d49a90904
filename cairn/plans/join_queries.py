"""Joins and lookups (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, hamming
from ..scale import numbered
from ..sources.content import CHUNKS, ENTRIES, VECTORS, chunks, entries, table, vectors
from .registry import query

#: Read requests: a byte range of each file.
REQUESTS = 'q AS (SELECT DISTINCT l_orderkey AS file, l_orderkey % 70 AS start, l_orderkey % 70 + 40 AS stop FROM lineitem)'


def requests(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file")).distinct()
    return f.select("file", (F.col("file") % 70).alias("start"), (F.col("file") % 70 + 40).alias("stop"))


@query("j01_entry_inode", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j01(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "j02_shared_content",
    f"""WITH {ENTRIES}, h AS (SELECT ino, sha256(text) AS h FROM e), g AS (SELECT h, count(*) AS n, min(ino) AS f FROM h GROUP BY h),
u AS (SELECT h, row_number() OVER (ORDER BY f) - 1 AS ix FROM g WHERE n = 1), s AS (SELECT h, row_number() OVER (ORDER BY f) - 1 AS ix FROM g WHERE n > 1), k AS (SELECT count(*) AS n FROM u)
SELECT ino, coalesce(u.ix, s.ix + k.n) AS content_ix FROM h LEFT JOIN u ON h.h = u.h LEFT JOIN s ON h.h = s.h, k""",
)
def j02(spark, d):
    e = entries(spark, d).select("ino", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    g = e.groupBy("h").agg(F.count("*").alias("n"), F.min("ino").alias("f"))
    ranked = numbered(g.withColumn("shared", F.col("n") > 1), ["shared", "f"], "content_ix")  # unique contents first, then shared ones
    return e.join(ranked, "h").select("ino", "content_ix")


@query("j03_content_chunks", f"WITH {CHUNKS} SELECT file, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS size, min(block) AS low_block, max(block) AS high_block FROM c WHERE file IN (SELECT o_orderkey FROM orders) GROUP BY file")
def j03(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"))
    return chunks(spark, d).join(files, "file", "left_semi").groupBy("file").agg(F.count("*").alias("chunks"), F.sum("size").alias("size"), F.min("block").alias("low_block"), F.max("block").alias("high_block"))


@query("j04_chunk_category", f"WITH {CHUNKS}, b AS (SELECT * FROM (VALUES (0, 'text'), (1, 'text'), (2, 'audio'), (3, 'binary')) AS b(block, kind)) SELECT file, ord, c.block, coalesce(kind, 'default') AS kind FROM c LEFT JOIN b ON c.block = b.block")
def j04(spark, d):
    b = spark.sql("SELECT * FROM VALUES (0L, 'text'), (1L, 'text'), (2L, 'audio'), (3L, 'binary') AS b(block, kind)")
    return chunks(spark, d).join(F.broadcast(b), "block", "left").select("file", "ord", "block", F.coalesce("kind", F.lit("default")).alias("kind"))


@query("j05_duplicate_probe", f"WITH {ENTRIES} SELECT ino, min(ino) OVER (PARTITION BY sha256(text)) AS first_ino FROM e")
def j05(spark, d):
    e = entries(spark, d).select("ino", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return e.join(e.groupBy("h").agg(F.min("ino").alias("first_ino")), "h").select("ino", "first_ino")


@query("j06_size_prefilter", f"WITH {ENTRIES} SELECT ino, size FROM e WHERE size IN (SELECT size FROM e GROUP BY size HAVING count(*) > 1)")
def j06(spark, d):
    return dedup.collision_candidates(entries(spark, d)).select("ino", "size")


@query("j07_hot_list", f"WITH {ENTRIES} SELECT ino, path FROM e WHERE ino IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j07(spark, d):
    hot = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("ino"))
    return entries(spark, d).select("ino", "path").join(hot, "ino", "left_semi")


@query("j08_explicit_order_join", f"WITH {ENTRIES} SELECT ino, item_id AS position FROM e LEFT JOIN (SELECT item_id, item_id * 7 AS k FROM benchmark) b ON ino = k")
def j08(spark, d):
    order = table(spark, d, "benchmark").select(F.col("item_id").alias("position"), (F.col("item_id") * 7).alias("ino"))
    return entries(spark, d).select("ino").join(order, "ino", "left").select("ino", "position")


@query("j09_find_path", f"WITH {ENTRIES} SELECT path, ino, size FROM e WHERE path IN (SELECT '/en/src' || (item_id % 20) || '/' || item_id FROM benchmark)")
def j09(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("/en/src"), (F.col("item_id") % 20).cast("string"), F.lit("/"), F.col("item_id").cast("string")).alias("path"))
    return entries(spark, d).select("path", "ino", "size").join(b, "path", "left_semi")


@query("j10_find_inode", "SELECT doc_id AS ino, lang, source FROM documents WHERE doc_id = 42")
def j10(spark, d):
    return table(spark, d, "documents").where("doc_id = 42").select(F.col("doc_id").alias("ino"), "lang", "source")


@query("j11_case_collisions", "SELECT lower(p_name) AS folded, count(DISTINCT p_name) AS spellings, min(p_partkey) AS first_key FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_partkey FROM part) GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def j11(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), "p_partkey")
    return p.groupBy(F.lower("p_name").alias("folded")).agg(F.countDistinct("p_name").alias("spellings"), F.min("p_partkey").alias("first_key")).where("spellings > 1")


@query(
    "j12_offset_chunk",
    f"""WITH {CHUNKS}, {REQUESTS} SELECT q.file, q.start, arg_max(c.ord, c."offset") AS ord, max(c."offset") AS chunk_offset FROM q JOIN c ON q.file = c.file AND c."offset" <= q.start AND c."offset" + c.size > q.start GROUP BY ALL""",
)
def j12(spark, d):
    hit = chunks(spark, d).join(requests(spark, d), "file").where("offset <= start AND offset + size > start")
    return hit.groupBy("file", "start").agg(F.max_by("ord", "offset").alias("ord"), F.max("offset").alias("chunk_offset"))


@query(
    "j13_next_hole",
    f"""WITH {CHUNKS}, {REQUESTS} SELECT q.file, q.start, min(greatest(c."offset", q.start)) AS hole FROM q JOIN c ON q.file = c.file AND c.hole AND c."offset" + c.size > q.start GROUP BY ALL""",
)
def j13(spark, d):
    hit = chunks(spark, d).where("hole").join(requests(spark, d), "file").where("offset + size > start")
    return hit.groupBy("file", "start").agg(F.min(F.greatest("offset", "start")).alias("hole"))


@query(
    "j14_range_overlap",
    f"""WITH {CHUNKS}, {REQUESTS} SELECT q.file, c.ord, greatest(c."offset", q.start) - c."offset" AS skip, least(c."offset" + c.size, q.stop) - greatest(c."offset", q.start) AS length FROM q JOIN c ON q.file = c.file AND c."offset" < q.stop AND c."offset" + c.size > q.start""",
)
def j14(spark, d):
    hit = chunks(spark, d).join(requests(spark, d), "file").where("offset < stop AND offset + size > start")
    low, high = F.greatest("offset", "start"), F.least(F.col("offset") + F.col("size"), F.col("stop"))
    return hit.select("file", "ord", (low - F.col("offset")).alias("skip"), (high - low).alias("length"))


@query("j15_hamming_join", f"WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM v a, v b WHERE a.vec_id < b.vec_id AND bit_count(xor(a.bits, b.bits)) <= 12")
def j15(spark, d):
    v = vectors(spark, d)
    return hamming.within(v, v, 12).where("a < b")


@query(
    "j16_hash_residual",
    "SELECT a.l_orderkey AS file, b.l_orderkey AS other, count(*) AS matches FROM (SELECT * FROM lineitem WHERE l_returnflag = 'A') a JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity GROUP BY ALL",
)
def j16(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_quantity", F.xxhash64("l_partkey", "l_quantity").alias("h"))
    a = li.where("l_returnflag = 'A'").select("h", F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    b = li.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "other")
    verified = (F.col("p") == F.col("l_partkey")) & (F.col("q") == F.col("l_quantity"))
    return a.join(b, "h").where(verified).groupBy("file", "other").agg(F.count("*").alias("matches"))


REBLOCK = """o AS (SELECT category, file, ord, size, CAST(sum(size) OVER w - size AS BIGINT) AS low, CAST(sum(size) OVER w AS BIGINT) AS high FROM c WHERE NOT hole WINDOW w AS (PARTITION BY category ORDER BY file, ord)),
m AS (SELECT category, file, ord, unnest(range(low // 4096, (high - 1) // 4096 + 1)) AS block, low, high FROM o WHERE size > 0)"""


@query("j17_block_mapping", f"""WITH {CHUNKS}, {REBLOCK} SELECT category, file, ord, block, greatest(low, block * 4096) - block * 4096 AS "offset", least(high, block * 4096 + 4096) - greatest(low, block * 4096) AS size FROM m""")
def j17(spark, d):
    from ..operators.packing import repacked

    return repacked(chunks(spark, d).where(~F.col("hole")), "category", ["file", "ord"], 4096).select("category", "file", "ord", "block", "offset", "size")


@query("j18_renumber_blocks", f"""WITH {CHUNKS}, b AS (SELECT category, block, row_number() OVER (ORDER BY category, block) - 1 AS physical FROM (SELECT DISTINCT category, block FROM c)) SELECT file, ord, physical FROM c JOIN b USING (category, block)""")
def j18(spark, d):
    c = chunks(spark, d)
    b = numbered(c.select("category", "block").distinct(), ["category", "block"], "physical")
    return c.join(b, ["category", "block"]).select("file", "ord", "physical")


@query("j19_hardlinks", "SELECT c_nationkey AS dev, c_custkey % 50 AS ino, count(*) AS links, min(c_name) AS first_path FROM customer GROUP BY ALL")
def j19(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("dev"), (F.col("c_custkey") % 50).alias("ino")).agg(F.count("*").alias("links"), F.min("c_name").alias("first_path"))
