"""Reads, reports, checks and scalar functions (Q and V)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.modes import permission_string
from ..operators import checking, reading
from ..operators import sequences as S
from ..operators import tree as T
from ..scale import numbered
from ..sources.content import CHUNKS, ENTRIES, TREE, chunks, entries, table, tree
from .join_queries import REQUESTS, requests
from .registry import query
from .scan_queries import UP, _perm_sql


@query("q01_walk", f"WITH {TREE}, {UP} SELECT path, is_dir, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS walk_ix FROM nodes")
def q01(spark, d):
    nodes = T.scan_tree(tree(spark, d)).select("path", "is_dir", T.walk_key(F.col("path")).alias("_k"))
    return numbered(nodes, ["_k"], "walk_ix").select("path", "is_dir", "walk_ix")


@query("q02_getattr", f"WITH {ENTRIES} SELECT ino, mode & ~146 AS mode, uid, gid, size, (size + 511) // 512 AS blocks FROM e")
def q02(spark, d):
    return entries(spark, d).select("ino", F.col("mode").bitwiseAND(F.lit(~0o222)).alias("mode"), "uid", "gid", "size", F.expr("(size + 511) div 512").alias("blocks"))


BODY = "x AS (SELECT doc_id AS file, k // 100 AS ord, k AS \"offset\", substr(text, k + 1, 100) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 100)) AS k FROM documents))"


@query("q03_read", "SELECT doc_id AS file, substr(text, CAST(doc_id % 70 AS INTEGER) + 1, 240) AS bytes FROM documents WHERE length(text) > doc_id % 70")
def q03(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    # of each text only the parts that the request meets are cut out, so a read costs what it asks for
    docs = docs.where("length(text) > doc_id % 70")
    at = F.sequence(F.floor(F.col("doc_id") % 70 / 100) * 100, F.least(F.length("text") - 1, F.col("doc_id") % 70 + 239), F.lit(100).cast("long"))
    parts = docs.select(F.col("doc_id").alias("file"), F.substring("text", 1, 70 + 240 + 100).alias("text"), F.explode(at.cast("array<int>")).alias("offset")).select("file", F.col("offset").cast("long").alias("offset"), F.substring(F.col("text"), F.col("offset") + 1, F.lit(100)).alias("part"))
    asked = docs.select(F.col("doc_id").alias("file"), (F.col("doc_id") % 70).alias("start"), F.lit(240).alias("length"))
    return reading.read_ranges(parts, asked)


@query("q04_readv", "SELECT doc_id AS file, count(*) AS parts FROM (SELECT doc_id, unnest(range(0, length(text), 100)) AS k FROM documents) WHERE k < doc_id % 70 + 240 AND k + 100 > doc_id % 70 GROUP BY doc_id HAVING count(*) <= 1024")
def q04(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    parts = docs.select(F.col("doc_id").alias("file"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(100))).alias("k"))
    return parts.where("k < file % 70 + 240 AND k + 100 > file % 70").groupBy("file").agg(F.count("*").alias("parts")).where("parts <= 1024")


@query(
    "q05_seek",
    f"""WITH {CHUNKS}, {REQUESTS}, f AS (SELECT file, CAST(sum(size) AS BIGINT) AS total FROM c GROUP BY file)
SELECT q.file, q.start, (SELECT min(greatest(c."offset", q.start)) FROM c WHERE c.file = q.file AND NOT c.hole AND c.size > 0 AND c."offset" + c.size > q.start) AS data,
coalesce((SELECT min(greatest(c."offset", q.start)) FROM c WHERE c.file = q.file AND c.hole AND c.size > 0 AND c."offset" + c.size > q.start), f.total) AS hole FROM q JOIN f ON q.file = f.file WHERE q.start < f.total""",
)
def q05(spark, d):
    return reading.seek(chunks(spark, d), requests(spark, d).select("file", "start"))


@query("q06_file_sizes", f"WITH {CHUNKS} SELECT file, CAST(sum(size) AS BIGINT) AS size, CAST(sum(CASE WHEN hole THEN 0 ELSE size END) AS BIGINT) AS allocated FROM c GROUP BY file")
def q06(spark, d):
    return chunks(spark, d).groupBy("file").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("hole"), 0).otherwise(F.col("size"))).alias("allocated"))


@query("q07_readlink", f"WITH {ENTRIES} SELECT ino, replace(path, '/', '\\') AS raw, path AS posix FROM e")
def q07(spark, d):
    raw = F.replace("path", F.lit("/"), F.lit("\\"))
    return entries(spark, d).select("ino", raw.alias("raw"), F.replace(raw, F.lit("\\"), F.lit("/")).alias("posix"))


@query("q08_inode_info", f"""WITH {CHUNKS} SELECT file, '{{"chunks":[' || string_agg('{{"block":' || block || ',"offset":' || "offset" || ',"size":' || size || '}}', ',' ORDER BY ord) || ']}}' AS info FROM c GROUP BY file""")
def q08(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block", "offset", "size"))), lambda x: F.struct(x["block"].alias("block"), x["offset"].alias("offset"), x["size"].alias("size")))
    return chunks(spark, d).groupBy("file").agg(listed.alias("chunks")).select("file", F.to_json(F.struct("chunks")).alias("info"))


@query("q09_info_report", f"""WITH {ENTRIES}, {CHUNKS} SELECT 'file_count' AS field, CAST(count(*) AS BIGINT) AS value FROM e UNION ALL SELECT 'total_size', CAST(sum(size) AS BIGINT) FROM e UNION ALL SELECT 'chunk_count', count(*) FROM c UNION ALL SELECT 'hole_size', CAST(sum(size) AS BIGINT) FROM c WHERE hole UNION ALL SELECT 'category_' || category, CAST(sum(size) AS BIGINT) FROM c GROUP BY category""")
def q09(spark, d):
    from ..operators.reports import info_report

    return info_report(entries(spark, d), chunks(spark, d), level=3)


@query("q10_directory_tree", f"WITH {TREE}, {UP} SELECT regexp_replace(path, '/[^/]*$', '') AS parent, string_agg(string_split(path, '/')[-1], '|' ORDER BY string_split(path, '/')[-1]) AS names FROM nodes GROUP BY 1")
def q10(spark, d):
    return T.scan_tree(tree(spark, d)).groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


@query("q11_blocks_by_category", f"WITH {CHUNKS} SELECT DISTINCT category, block FROM c WHERE category = 'A'")
def q11(spark, d):
    return chunks(spark, d).where("category = 'A'").select("category", "block").distinct()


@query(
    "q12_section_check",
    """WITH s AS (SELECT doc_id, CASE doc_id % 100 WHEN 11 THEN 'metadata' WHEN 12 THEN 'history' ELSE 'block' END AS kind FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS k FROM s)
SELECT level, error, doc_id AS number FROM n, (VALUES ('checksum'), ('integrity')) AS l(level), (VALUES ('damaged'), ('duplicate')) AS x(error)
WHERE error = 'duplicate' AND kind = 'metadata' AND k > 1 OR error = 'damaged' AND (doc_id % 100 = 7 OR doc_id % 100 = 8 AND level = 'integrity')""",
)
def q12(spark, d):
    """One document a section: of every hundred one has both digests wrong, one only the strong one; one is metadata, of which an image has one."""
    k = F.col("number") % 100
    kind = F.when(k == 11, "metadata").when(k == 12, "history").otherwise("block")
    s = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.coalesce("text", F.lit("")).cast("binary").alias("payload")).withColumn("kind", kind)
    other = F.concat("payload", F.lit("!").cast("binary"))
    s = s.withColumns({"fast": F.xxhash64(F.when(k == 7, other).otherwise(F.col("payload"))), "digest": F.sha2(F.when(k.isin(7, 8), other).otherwise(F.col("payload")), 256)})
    found = [checking.section_errors(s, level).select(F.lit(level).alias("level"), "error", "number") for level in ("checksum", "integrity")]
    return found[0].unionByName(found[1])


_META = f"""{ENTRIES}, d AS (SELECT '' AS path UNION SELECT '/' || lang FROM documents UNION SELECT parent FROM e), k AS (SELECT (SELECT count(*) FROM d) AS dirs, (SELECT count(*) FROM e) AS files),
nodes AS (SELECT lang AS name FROM documents UNION SELECT source FROM documents UNION SELECT name FROM e), z AS (SELECT CAST(ceil(sum(size) / 65536) AS BIGINT) + count(*) AS most FROM e),
f AS (SELECT path, size, CAST(sum(size) OVER (ORDER BY path) AS BIGINT) AS high FROM e), p AS (SELECT path, unnest(range((high - size) // 65536, (high - 1) // 65536 + 1)) AS block FROM f WHERE size > 0)"""


def _metadata(spark, d):
    from ..operators.metadata import normalized

    return normalized(entries(spark, d), 65536)


@query("q13_consistent_metadata", f"WITH {_META} SELECT t, CAST(n AS BIGINT) AS n FROM (SELECT unnest(['inodes', 'directories', 'dir_entries', 'names', 'chunk_table', 'chunks', 'violations']) AS t, unnest([dirs + files, dirs + 1, dirs + files, (SELECT count(*) FROM nodes), files + 1, (SELECT count(*) FROM p), 0]) AS n FROM k)")
def q13_clean(spark, d):
    from ..operators.metadata import consistency

    meta = _metadata(spark, d)
    counts = [meta.tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("inodes", "directories", "dir_entries", "names", "chunk_table", "chunks")]
    counts.append(consistency(meta).agg(F.count("*").alias("n")).select(F.lit("violations").alias("t"), "n"))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(
    "q13_consistency",
    f"""WITH {_META}, c AS (SELECT count(*) AS chunks FROM p), i AS (SELECT unnest(range(dirs + files)) AS ix FROM k), x AS (SELECT unnest(range(chunks)) AS ix FROM c)
SELECT 'index ranges' AS family, 'owner_index' AS rule, ix AS id FROM i WHERE ix % 97 = 5 UNION ALL SELECT 'index ranges', 'inode_num', ix FROM i WHERE ix % 89 = 7
UNION ALL SELECT 'packed tables', 'self_entry is parent_entry', 3 UNION ALL SELECT 'packed tables', 'end of chunk_table', NULL UNION ALL SELECT 'string tables', 'length of name', 11
UNION ALL SELECT 'chunks', 'end', ix FROM x WHERE ix % 50 = 9 UNION ALL SELECT 'chunks', 'large hole index', ix FROM x WHERE ix % 50 = 10
UNION ALL SELECT 'partitioning', 'inodes', max(ix) FROM i UNION ALL SELECT 'counts', unnest(['directories', 'files']), NULL""",
)
def q13(spark, d):
    """The metadata of all documents with faults planted in six of the seven families (an empty table is tested alone)."""
    from ..operators.metadata import LARGE_HOLE, consistency

    meta = _metadata(spark, d)
    t, ix = meta.tables, F.col("ix")
    last = t["inodes"].count() - 1
    folder = t["modes"].where("value = 16877").first()["ix"]
    nine, ten = ix % 50 == 9, ix % 50 == 10
    broken = meta.with_tables(
        inodes=t["inodes"].withColumns({"owner_index": F.when(ix % 97 == 5, 1000).otherwise(F.col("owner_index")), "mode_index": F.when(ix == last, folder).otherwise(F.col("mode_index"))}),
        dir_entries=t["dir_entries"].withColumn("inode_num", F.when(ix % 89 == 7, F.col("inode_num") + last + 1).otherwise(F.col("inode_num"))),
        directories=t["directories"].withColumn("self_entry", F.when(ix == 3, F.col("parent_entry")).otherwise(F.col("self_entry"))),
        chunk_table=t["chunk_table"].withColumn("first_chunk", F.col("first_chunk") + F.when(ix == last + 1 - (t["directories"].count() - 1), 1).otherwise(0)),
        names=t["names"].withColumn("value", F.when(ix == 11, F.repeat(F.lit("n"), 513)).otherwise(F.col("value"))),
        chunks=t["chunks"].select("ix", F.when(ten, 1 << 20).otherwise(F.col("block")).alias("block"), F.when(nine, 32768).when(ten, LARGE_HOLE).otherwise(F.col("offset")).alias("offset"), F.when(nine, 32769).when(ten, 5).otherwise(F.col("size")).alias("size")),
    )
    return consistency(replace(broken, hole_block=1 << 20, sparse=True))


@query("q14_size_cache", f"WITH {CHUNKS}, f AS (SELECT file, CAST(sum(size) AS BIGINT) AS size, count(*) AS n FROM c GROUP BY file) SELECT file, size + CASE WHEN file % 50 = 3 THEN 1 ELSE 0 END AS cached, size AS actual FROM f WHERE n >= 4 AND file % 50 = 3")
def q14(spark, d):
    actual = chunks(spark, d).groupBy("file").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where("n >= 4").select("file", "size")
    cached = actual.withColumn("size", F.col("size") + F.when(F.col("file") % 50 == 3, 1).otherwise(0))
    return checking.mismatches(cached, actual, "file", "size")


@query("q16_raw_block", f"WITH {CHUNKS} SELECT file, ord, size FROM c WHERE block = 3 AND NOT hole")
def q16(spark, d):
    return chunks(spark, d).where("block = 3 AND NOT hole").select("file", "ord", "size")


def _four(value: str, k: int) -> str:
    return f"CASE WHEN contains(printf('%.{k}f', {value}), '.') THEN regexp_replace(printf('%.{k}f', {value}), '\\.?0+$', '') ELSE printf('%.{k}f', {value}) END"


@query("v01_size_with_unit", f"""WITH {ENTRIES}, s AS (SELECT ino, size * size AS size FROM e), m AS (SELECT ino, size, (length(bin(size | 1)) - 1) // 10 AS k FROM s), w AS (SELECT *, size / pow(1024.0, k) AS v FROM m)
SELECT ino, CASE WHEN floor(v) >= 1000 THEN {_four('v', 0)} WHEN floor(v) >= 100 THEN {_four('v', 1)} WHEN floor(v) >= 10 THEN {_four('v', 2)} ELSE {_four('v', 3)} END || ' ' || (['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB'])[k + 1] AS text FROM w""")
def v01(spark, d):
    return entries(spark, d).select("ino", units.size_with_unit(F.col("size") * F.col("size")).alias("text"))


@query("v02_time_with_unit")
def v02(spark, d):
    e = entries(spark, d).select("ino", (F.col("size") * F.col("size") * F.col("size") * 37).alias("ns"))
    return e.select("ino", "ns", units.time_with_unit(F.col("ns")).alias("text"))


@query("v03_ratio_to_string")
def v03(spark, d):
    c = chunks(spark, d).groupBy("file").agg(F.sum(F.when(F.col("hole"), 0).otherwise(F.col("size"))).alias("stored"), F.sum("size").alias("total"))
    return c.select("file", units.ratio_to_string(F.col("stored"), F.col("total")).alias("ratio"))


@query("v04_parse_size", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE p_size::BIGINT * ([1, 1024, 1048576, 1073741824, 1099511627776])[1 + p_partkey % 6] END AS bytes FROM part")
def v04(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ["", "k", "M", "g", "T", "tb"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", units.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("v05_time_resolution", "SELECT event_id, epoch_us(ts) // 10000000 AS value, epoch_us(ts) % 10000000 // 10000 AS subsec, epoch_us(ts) // 10000000 * 10 AS aligned FROM events")
def v05(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", us.alias("us")).select("event_id", F.expr("us div 10000000").alias("value"), F.expr("us % 10000000 div 10000").alias("subsec"), F.expr("us div 10000000 * 10").alias("aligned"))


@query("v06_parse_time", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_size::BIGINT * ([1000000, 1000000000, 60000000000, 86400000000000])[1 + p_partkey % 5] END AS ns FROM part")
def v06(spark, d):
    unit = F.element_at(F.array(*map(F.lit, [" msec", "", "m", "d", "y"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", units.parse_time(F.concat(F.col("p_size").cast("string"), unit)).alias("ns"))


@query("v07_parse_time_point", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE epoch_us(o_orderdate) END AS us FROM orders")
def v07(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(t, "yyyyMMdd'T'HHmmss")).when(F.col("o_orderkey") % 5 == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 5 == 2, F.date_format(t, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm")).otherwise("2020-01-01 01:02x")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(units.parse_time_point(text).cast("timestamp")).alias("us"))


@query("v08_display_width")
def v08(spark, d):
    from ..functions.texts import display_width, truncate_width

    return table(spark, d, "documents").select("doc_id", display_width("text").alias("width"), truncate_width("text").alias("shown"))


@query("v09_utf8_sanitize", "SELECT doc_id, md5(text) AS digest FROM documents")
def v09(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.make_valid_utf8("text").cast("binary")).alias("digest"))


@query("v10_shorten_path")
def v10(spark, d):
    from ..functions.texts import shorten_path

    return tree(spark, d).select("page_id", "path", shorten_path("path").alias("short"))


@query("v11_basename", f"WITH {TREE} SELECT page_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM t")
def v11(spark, d):
    return tree(spark, d).select("page_id", units.basename(F.col("path")).alias("name"))


@query("v12_hexlify", "SELECT doc_id, lower(hex(text)) AS hex FROM documents")
def v12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("hex"))


@query("v13_mode_string", f"WITH {ENTRIES} SELECT ino, {_perm_sql('mode')} AS permissions FROM e")
def v13(spark, d):
    return entries(spark, d).select("ino", permission_string(F.col("mode")).alias("permissions"))


@query("v14_to_bool", "SELECT c_custkey, ([true, false, true, false, NULL])[1 + c_custkey % 5] AS truth FROM customer")
def v14(spark, d):
    word = F.element_at(F.array(*map(F.lit, ["Yes", "OFF", "1", "f", "maybe"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", units.to_bool(word).alias("truth"))


@query("v15_unix_path", f"WITH {TREE}, {UP} SELECT path || CASE WHEN is_dir THEN '/' ELSE '' END AS path FROM nodes")
def v15(spark, d):
    return T.scan_tree(tree(spark, d)).select(F.concat("path", F.when(F.col("is_dir"), "/").otherwise("")).alias("path"))


@query("v16_case_fold")
def v16(spark, d):
    from ..functions.texts import simple_fold

    return table(spark, d, "documents").select("doc_id", F.md5(simple_fold("text").cast("binary")).alias("folded"))


@query("v18_category_string", f"WITH {CHUNKS} SELECT file, ord, category || '/' || block AS label, '[' || category || '] ' AS prefix FROM c")
def v18(spark, d):
    return chunks(spark, d).select("file", "ord", F.concat("category", F.lit("/"), F.col("block").cast("string")).alias("label"), F.concat(F.lit("["), "category", F.lit("] ")).alias("prefix"))


DATA = """r AS (SELECT *, CASE WHEN lag(hole) OVER w = hole THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY file ORDER BY ord)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ord) AS k FROM r),
x AS (SELECT file, any_value(hole) AS hole, min("offset") AS start, CAST(min("offset") + sum(size) AS BIGINT) AS stop FROM g GROUP BY file, k)"""


def extents(spark, d):
    before = F.lag("hole").over(Window.partitionBy("file").orderBy("ord"))
    runs = S.islands(chunks(spark, d).withColumn("_p", before), ["file"], ["ord"], ~F.col("_p").eqNullSafe(F.col("hole")))
    return runs.groupBy("file", "island").agg(F.first("hole").alias("hole"), F.min("offset").alias("start"), (F.min("offset") + F.sum("size")).alias("stop")).drop("island")


@query("v19_intersect_ranges", f"WITH {CHUNKS}, {DATA}, {REQUESTS} SELECT x.file, greatest(x.start, q.start) AS start, least(x.stop, q.stop) AS stop FROM x JOIN q ON x.file = q.file WHERE NOT hole AND x.start < q.stop AND q.start < x.stop")
def v19(spark, d):
    return S.intersect_ranges(extents(spark, d).where("NOT hole"), requests(spark, d), "file")


@query("v19_complement_ranges", f"WITH {CHUNKS}, {DATA} SELECT file, start, stop FROM x WHERE hole")
def v19_complement(spark, d):
    x = extents(spark, d)
    sizes = x.groupBy("file").agg(F.max("stop").alias("size"))
    return S.complement_ranges(x.where("NOT hole"), sizes, "file")


@query("v20_bit_width", f"WITH {ENTRIES} SELECT parent, length(bin(max(size))) AS bits FROM e GROUP BY parent")
def v20(spark, d):
    return entries(spark, d).groupBy("parent").agg(units.bit_width(F.max("size")).cast("long").alias("bits"))
