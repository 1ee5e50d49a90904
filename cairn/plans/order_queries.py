"""Window-shaped operators, orders and set operations (W, P and U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hamming
from ..operators import sequences as S
from ..operators import tree as T
from ..scale import numbered
from ..sources.content import CHUNKS, ENTRIES, TREE, VECTORS, chunks, entries, table, tree, vectors
from .registry import query
from .scan_queries import UP

FIRSTS = 'f AS (SELECT file, CAST(sum(count(*)) OVER (ORDER BY file) - count(*) AS BIGINT) AS first_chunk FROM c GROUP BY file)'


def chunk_table(spark, d):
    """First chunk number of each file."""
    from ..scale import running

    counts = chunks(spark, d).groupBy("file").agg(F.count("*").alias("n"))
    return running(counts, ["file"], {"first_chunk": F.col("n")}, inclusive=False).select("file", F.col("first_chunk").cast("long").alias("first_chunk"))


@query("w01_delta_encode", f"WITH {CHUNKS}, {FIRSTS} SELECT file, first_chunk, first_chunk - coalesce(lag(first_chunk) OVER (ORDER BY file), 0) AS delta FROM f")
def w01(spark, d):
    return S.delta_encode(chunk_table(spark, d), "first_chunk", ["file"])


@query("w02_delta_decode", f"WITH {CHUNKS}, {FIRSTS} SELECT file, first_chunk AS value FROM f")
def w02(spark, d):
    return S.delta_decode(S.delta_encode(chunk_table(spark, d), "first_chunk", ["file"]), "delta", ["file"]).select("file", F.col("value").cast("long").alias("value"))


@query("w03_directory_entries", f"WITH {TREE}, {UP}, n AS (SELECT regexp_replace(path, '/[^/]*$', '') AS parent, count(*) AS entries FROM nodes GROUP BY 1) SELECT parent, entries, CAST(sum(entries) OVER (ORDER BY parent) - entries AS BIGINT) AS first_entry FROM n")
def w03(spark, d):
    from ..scale import running

    n = T.scan_tree(tree(spark, d)).groupBy("parent").agg(F.count("*").alias("entries"))
    return running(n, ["parent"], {"first_entry": F.col("entries")}, inclusive=False).select("parent", "entries", F.col("first_entry").cast("long").alias("first_entry"))


@query("w04_pack_shared", f"WITH {ENTRIES} SELECT sha256(text) AS digest, count(*) - 2 AS packed FROM e GROUP BY 1 HAVING count(*) >= 2")
def w04(spark, d):
    return S.pack_runs(entries(spark, d).select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digest")


@query("w04_unpack_shared", f"WITH {ENTRIES}, p AS (SELECT sha256(text) AS digest, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 2) SELECT digest, unnest(range(n)) AS copy FROM p")
def w04_unpack(spark, d):
    return S.unpack_runs(w04(spark, d), "digest", "packed")


@query("w05_string_index", "SELECT c_custkey, CAST(sum(strlen(c_name)) OVER (ORDER BY c_custkey) - strlen(c_name) AS BIGINT) AS start, strlen(c_name) AS length FROM customer")
def w05(spark, d):
    from ..scale import running

    c = table(spark, d, "customer").select("c_custkey", F.octet_length("c_name").cast("long").alias("length"))
    return running(c, ["c_custkey"], {"start": F.col("length")}, inclusive=False).select("c_custkey", F.col("start").cast("long").alias("start"), "length")


@query("w06_chunk_offsets", f'WITH {CHUNKS} SELECT file, ord, "offset" FROM c')
def w06(spark, d):
    return chunks(spark, d).select("file", "ord", "offset")


PLACED = """p AS (SELECT *, CAST("offset" + 10 * sum(CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ord) AS BIGINT) AS block_offset, ord // 2 AS b FROM c)"""


@query(
    "w07_merge_chunks",
    f"""WITH {CHUNKS}, {PLACED}, r AS (SELECT file, ord, b AS block, block_offset, size, CASE WHEN lag(b) OVER w = b AND lag(block_offset + size) OVER w = block_offset THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY file ORDER BY ord)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) AS k FROM r) SELECT file, min(ord) AS ord, any_value(block) AS block, min(block_offset) AS block_offset, CAST(sum(size) AS BIGINT) AS size, count(*) AS parts FROM g GROUP BY file, k""",
)
def w07(spark, d):
    w = Window.partitionBy("file").orderBy("ord")
    c = chunks(spark, d)
    placed = c.select("file", "ord", "size", F.expr("ord div 2").alias("block"), (F.col("offset") + 10 * F.sum(F.when(F.col("size") % 3 == 0, 1).otherwise(0)).over(w)).alias("block_offset"))
    return S.merge_adjacent(placed)


@query("w08_category_runs", f"WITH {CHUNKS}, r AS (SELECT *, CASE WHEN lag(category) OVER w = category THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY file ORDER BY ord)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) AS k FROM r) SELECT file, min(ord) AS ord, any_value(category) AS category, CAST(sum(size) AS BIGINT) AS length FROM g GROUP BY file, k")
def w08(spark, d):
    before = F.lag("category").over(Window.partitionBy("file").orderBy("ord"))
    runs = S.islands(chunks(spark, d).withColumn("_p", before), ["file"], ["ord"], ~F.col("_p").eqNullSafe(F.col("category")))
    return runs.groupBy("file", "island").agg(F.min("ord").alias("ord"), F.first("category").alias("category"), F.sum("size").alias("length")).drop("island")


RANK = "CASE WHEN size = 0 THEN 4 WHEN n > 1 THEN 3 ELSE 2 END"


@query("w09_inode_numbers", f"WITH {ENTRIES}, s AS (SELECT *, count(*) OVER (PARTITION BY sha256(text)) AS n FROM e) SELECT ino AS doc_id, {RANK} AS rank, row_number() OVER (ORDER BY {RANK}, ino) - 1 AS inode FROM s")
def w09(spark, d):
    e = entries(spark, d).select(F.col("ino").alias("doc_id"), "size", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    n = e.groupBy("h").agg(F.count("*").alias("n"))
    rank = F.when(F.col("size") == 0, 4).when(F.col("n") > 1, 3).otherwise(2)
    return numbered(e.join(n, "h").select("doc_id", rank.alias("rank")), ["rank", "doc_id"], "inode")


@query("w10_sorted_dictionary", "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS ix FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def w10(spark, d):
    return S.sorted_dictionary(table(spark, d, "orders"), "o_orderpriority")


@query("w11_first_seen_dictionary", "SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS ix FROM customer GROUP BY c_mktsegment")
def w11(spark, d):
    return S.first_seen_dictionary(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("w12_extents", f"""WITH {CHUNKS}, r AS (SELECT *, CASE WHEN lag(hole) OVER w = hole THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY file ORDER BY ord)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) AS k FROM r) SELECT file, any_value(hole) AS hole, min("offset") AS "offset", CAST(sum(size) AS BIGINT) AS length FROM g GROUP BY file, k""")
def w12(spark, d):
    before = F.lag("hole").over(Window.partitionBy("file").orderBy("ord"))
    runs = S.islands(chunks(spark, d).withColumn("_p", before), ["file"], ["ord"], ~F.col("_p").eqNullSafe(F.col("hole")))
    return runs.groupBy("file", "island").agg(F.first("hole").alias("hole"), F.min("offset").alias("offset"), F.sum("size").alias("length")).drop("island")


@query("w13_hamming_path", f"WITH {VECTORS} SELECT CAST(sum(bit_count(xor(bits, p))) AS BIGINT) AS total_distance FROM (SELECT bits, lag(bits) OVER (ORDER BY vec_id) AS p FROM v)")
def w13(spark, d):
    return hamming.path_length(vectors(spark, d), ["vec_id"])


def _position(name: str, spark_order, sql_order: str, key: str = "ino", extra=None):
    @query(name, f"WITH {ENTRIES} SELECT {key}, row_number() OVER (ORDER BY {sql_order}) - 1 AS position FROM e")
    def run(spark, d):
        e = entries(spark, d)
        keys = spark_order()
        cols = {f"_k{i}": k for i, k in enumerate(keys)}
        return numbered(e.withColumns(cols).select(key, *cols), list(cols), "position").select(key, "position")

    return run


_position("p01_by_inode", lambda: [F.col("ino")], "ino")
_position("p02_by_path", lambda: [F.col("path")], "path")
_position("p03_by_reverse_path", lambda: [T.reverse_path(F.col("path"))], "list_reverse(string_split(path[2:], '/'))")
_position("p05_similarity_order", lambda: [F.col("size") >= 2000, F.when(F.col("size") >= 2000, F.col("size") % 16).otherwise(0), -F.col("size"), T.reverse_path(F.col("path"))], "size >= 2000, CASE WHEN size >= 2000 THEN size % 16 ELSE 0 END, -size, list_reverse(string_split(path[2:], '/'))")
_position("p09_directory_sort", lambda: [F.col("parent"), F.col("name")], "parent, name")


@query("p04_explicit_order", f"WITH {ENTRIES}, o AS (SELECT ino, item_id AS pos FROM e LEFT JOIN (SELECT item_id, item_id * 7 AS k FROM benchmark) b ON ino = k) SELECT ino, row_number() OVER (ORDER BY pos IS NULL, coalesce(pos, 0), ino) - 1 AS position FROM o")
def p04(spark, d):
    order = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 7).alias("ino"))
    o = entries(spark, d).select("ino").join(order, "ino", "left").select("ino", F.col("pos").isNull().alias("unlisted"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return numbered(o, ["unlisted", "pos", "ino"], "position").select("ino", "position")


@query("p08_data_order", f"WITH {CHUNKS}, f AS (SELECT file, arg_min(block, ord) AS b, count(*) AS n FROM c GROUP BY file) SELECT file, row_number() OVER (ORDER BY n > 1, CASE WHEN n > 1 THEN b ELSE 0 END, file) - 1 AS position FROM f")
def p08(spark, d):
    f = chunks(spark, d).groupBy("file").agg(F.min_by("block", "ord").alias("b"), F.count("*").alias("n"))
    keyed = f.select("file", (F.col("n") > 1).alias("is_file"), F.when(F.col("n") > 1, F.col("b")).otherwise(0).alias("b"))
    return numbered(keyed, ["is_file", "b", "file"], "position").select("file", "position")


@query("p10_preorder_walk", f"WITH {TREE}, {UP} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS position FROM nodes")
def p10(spark, d):
    nodes = T.scan_tree(tree(spark, d)).select("path", T.walk_key(F.col("path")).alias("_k"))
    return numbered(nodes, ["_k"], "position").select("path", "position")


@query("p11_top4", f"WITH {CHUNKS}, g AS (SELECT category, block, count(*) AS n FROM c GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, block) AS rank FROM g) WHERE rank <= 4")
def p11(spark, d):
    g = chunks(spark, d).groupBy("category", "block").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "block")).cast("long")).where("rank <= 4")


@query("p12_best_match", f"WITH {CHUNKS} SELECT file, m.s AS size, m.b AS block, m.o AS \"offset\" FROM (SELECT file, max(struct_pack(s := size, b := block, o := \"offset\")) AS m FROM c GROUP BY file)")
def p12(spark, d):
    m = chunks(spark, d).groupBy("file").agg(F.max(F.struct("size", "block", "offset")).alias("m"))
    return m.select("file", "m.size", "m.block", "m.offset")


@query("p13_chunk_list", f"WITH {CHUNKS} SELECT file, CASE WHEN count(*) > 5 THEN '...' ELSE string_agg(size, ',' ORDER BY ord) END AS chunks FROM c GROUP BY file")
def p13(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "size"))), lambda x: x["size"].cast("string")), ",")
    return chunks(spark, d).groupBy("file").agg(F.count("*").alias("n"), listed.alias("l")).select("file", F.when(F.col("n") > 5, "...").otherwise(F.col("l")).alias("chunks"))


@query("p14_readdir_page", f"WITH {ENTRIES}, r AS (SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY name) + 1 AS pos FROM e), a AS (SELECT * FROM r UNION ALL SELECT DISTINCT parent, '.', 0 FROM e UNION ALL SELECT DISTINCT parent, '..', 1 FROM e) SELECT parent, name, pos FROM a WHERE pos >= 1 AND pos < 6")
def p14(spark, d):
    e = entries(spark, d)
    listed = e.select("parent", "name", (F.row_number().over(Window.partitionBy("parent").orderBy("name")) + 1).cast("long").alias("pos"))
    dots = e.select("parent").distinct().select("parent", F.inline(F.array(F.struct(F.lit(".").alias("name"), F.lit(0).cast("long").alias("pos")), F.struct(F.lit("..").alias("name"), F.lit(1).cast("long").alias("pos")))))
    return listed.unionByName(dots).where("pos >= 1 AND pos < 6")


@query("u01_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def u01(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").where("toxic = 1").select("doc_id"))


@query("u02_ancestor_union", f"WITH {TREE}, {UP} SELECT path FROM dirs UNION SELECT path FROM t WHERE regexp_matches(path, '/en/')")
def u02(spark, d):
    t = tree(spark, d)
    return t.select(F.explode(T.ancestors(F.col("path"))).alias("path")).union(t.where(F.col("path").contains("/en/")).select("path")).distinct()


@query("u03_detail_levels", "SELECT CAST(k AS BIGINT) AS level, array_to_string((['version', 'history', 'summary', 'frozen', 'names', 'chunks'])[:k + 1], ',') AS features FROM range(6) r(k)")
def u03(spark, d):
    names = F.array(*map(F.lit, ["version", "history", "summary", "frozen", "names", "chunks"]))
    return spark.range(6).select(F.col("id").alias("level"), F.array_join(F.slice(names, F.lit(1), F.col("id").cast("int") + 1), ",").alias("features"))


@query("u04_history_concat", "SELECT c_custkey AS version, c_name AS arguments, 'new' AS state FROM customer UNION ALL SELECT s_suppkey, s_name, 'old' FROM supplier")
def u04(spark, d):
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("version"), F.col("c_name").alias("arguments"), F.lit("new").alias("state"))
    return new.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("version"), F.col("s_name").alias("arguments"), F.lit("old").alias("state")))


@query("u05_bitmap_union", "SELECT l_returnflag, count(DISTINCT l_partkey % 4096) AS bits FROM lineitem GROUP BY l_returnflag")
def u05(spark, d):
    one = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_partkey") % 4096).alias("k"))
    maps = one.groupBy("l_returnflag", "l_linestatus").agg(F.bitmap_construct_agg("k").alias("m"))
    return maps.groupBy("l_returnflag").agg(F.bitmap_count(F.bitmap_or_agg("m")).alias("bits"))


@query("u06_option_sets", "SELECT c_custkey, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'flag', NULL FROM customer")
def u06(spark, d):
    text = F.concat(F.lit("segment="), "c_mktsegment", F.lit(",nation="), F.col("c_nationkey").cast("string"), F.lit(",flag"))
    return table(spark, d, "customer").select("c_custkey", F.explode(F.str_to_map(text, F.lit(","), F.lit("="))).alias("key", "value"))


REPACK = 'CAST(sum(size) OVER (PARTITION BY category ORDER BY file, ord) - size AS BIGINT) AS low'


@query("r11_simple_packing", f"""WITH {CHUNKS}, o AS (SELECT category, file, ord, size, {REPACK} FROM c WHERE size > 0), m AS (SELECT *, unnest(range(low // 1024, (low + size - 1) // 1024 + 1)) AS block FROM o) SELECT category, file, ord, block, greatest(low - block * 1024, 0) AS "offset", least(low + size, block * 1024 + 1024) - greatest(low, block * 1024) AS size FROM m""")
def r11(spark, d):
    from ..operators.packing import repacked

    return repacked(chunks(spark, d), "category", ["file", "ord"], 1024).select("category", "file", "ord", "block", "offset", "size")


@query("r01_block_merge", "SELECT label AS source, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slot, row_number() OVER (ORDER BY r, label) - 1 AS position FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)")
def r01(spark, d):
    from ..operators.merging import round_robin

    e = table(spark, d, "embeddings").select(F.col("label").alias("source"), "vec_id")
    return round_robin(e, "source", ["vec_id"])


@query("r02_chunk_table", f"WITH {CHUNKS}, {FIRSTS} SELECT file, first_chunk FROM f UNION ALL SELECT NULL, count(*) FROM c")
def r02(spark, d):
    return chunk_table(spark, d).unionByName(chunks(spark, d).agg(F.count("*").alias("first_chunk")).select(F.lit(None).cast("long").alias("file"), "first_chunk"))


@query("r03_directory_table", f"WITH {TREE}, {UP}, n AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM nodes) SELECT path, parent, row_number() OVER (ORDER BY string_split(parent, '/'), string_split(path, '/')[-1]) - 1 AS entry_ix FROM n")
def r03(spark, d):
    nodes = T.scan_tree(tree(spark, d)).select("path", "parent", T.walk_key(F.col("parent")).alias("_k"), "name")
    return numbered(nodes, ["_k", "name"], "entry_ix").select("path", "parent", "entry_ix")


@query("r04_hole_codes", f"""WITH {CHUNKS}, h AS (SELECT file, ord, size * 300000000000 AS size FROM c WHERE hole), l AS (SELECT size, row_number() OVER (ORDER BY min(ord), size) - 1 AS ix FROM h WHERE size // 1024 >= 4294967295 GROUP BY size)
SELECT file, ord, h.size, CASE WHEN h.size // 1024 < 4294967295 THEN h.size // 1024 ELSE ix END AS chunk_size, CASE WHEN h.size // 1024 < 4294967295 THEN h.size % 1024 ELSE 4294967295 END AS chunk_offset FROM h LEFT JOIN l ON h.size = l.size""")
def r04(spark, d):
    from ..operators.packing import hole_codes

    holes = chunks(spark, d).where("hole").select("file", "ord", (F.col("size") * F.lit(300000000000)).alias("size"))
    return hole_codes(holes, 1024).select("file", "ord", "size", "chunk_size", "chunk_offset")


@query("r07_change_block_size", f"""WITH {CHUNKS}, o AS (SELECT category, size, {REPACK} FROM c WHERE size > 0), m AS (SELECT category, unnest(range(low // 2048, (low + size - 1) // 2048 + 1)) AS block, low, size FROM o) SELECT category, block, count(*) AS parts, CAST(sum(least(low + size, block * 2048 + 2048) - greatest(low, block * 2048)) AS BIGINT) AS filled FROM m GROUP BY ALL""".replace("ORDER BY file, ord", "ORDER BY file, ord"))
def r07(spark, d):
    from ..operators.packing import repacked

    return repacked(chunks(spark, d), "category", ["file", "ord"], 2048).groupBy("category", "block").agg(F.count("*").alias("parts"), F.sum("size").alias("filled"))


@query("r08_remap_chunks", f"""WITH {CHUNKS}, o AS (SELECT category, file, ord, size, {REPACK} FROM c WHERE size > 0), m AS (SELECT *, unnest(range(low // 512, (low + size - 1) // 512 + 1)) AS block FROM o) SELECT file, ord, count(*) AS parts, min(block) AS first_block, max(block) AS last_block FROM m GROUP BY ALL""")
def r08(spark, d):
    from ..operators.packing import repacked

    return repacked(chunks(spark, d), "category", ["file", "ord"], 512).groupBy("file", "ord").agg(F.count("*").alias("parts"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))


@query("r09_rebuild_metadata", f"WITH {ENTRIES} SELECT ino, mode & ~18 AS mode, 1000 AS uid, gid, (1600000000 + ino) // 60 AS mtime FROM e")
def r09(spark, d):
    return entries(spark, d).select("ino", F.col("mode").bitwiseAND(F.lit(~0o22)).alias("mode"), F.lit(1000).alias("uid"), "gid", F.expr("(1600000000 + ino) div 60").alias("mtime"))


@query("r10_version_history", "SELECT n_nationkey AS position, CAST(n_regionkey AS VARCHAR) || '.0' AS version FROM nation UNION ALL SELECT count(*)::INTEGER, '9.0' FROM nation")
def r10(spark, d):
    n = table(spark, d, "nation")
    old = n.select(F.col("n_nationkey").alias("position"), F.concat(F.col("n_regionkey").cast("string"), F.lit(".0")).alias("version"))
    return old.unionByName(n.agg(F.count("*").cast("int").alias("position")).withColumn("version", F.lit("9.0")))
