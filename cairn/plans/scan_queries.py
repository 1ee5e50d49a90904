"""Scans, sinks and filters (S, K and F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import globbing, modes
from ..functions.kernels import checksum
from ..operators import tree as T
from ..sources.content import CHUNKS, ENTRIES, TREE, chunks, entries, table, tree
from .registry import query

UP = """up AS (SELECT path, string_split(path[2:], '/') AS p FROM t),
dirs AS (SELECT DISTINCT '/' || array_to_string(p[:k], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS k FROM up)),
nodes AS (SELECT path, true AS is_dir FROM dirs UNION ALL SELECT path, false FROM (SELECT DISTINCT path FROM t) WHERE path NOT IN (SELECT path FROM dirs))"""


@query("s01_scan_tree", f"WITH {TREE}, {UP} SELECT path, is_dir, len(string_split(path, '/')) - 1 AS depth, regexp_replace(path, '/[^/]*$', '') AS parent, string_split(path, '/')[-1] AS name FROM nodes")
def s01(spark, d):
    return T.scan_tree(tree(spark, d))


@query(
    "s02_list_scan",
    f"""WITH {ENTRIES}, l AS (SELECT '/' || lang || '/./' || source || '//' || doc_id AS raw, row_number() OVER (ORDER BY doc_id % 97, doc_id) - 1 AS pos FROM documents UNION ALL SELECT '/../outside', -1),
n AS (SELECT regexp_replace(replace(raw, '/./', '/'), '/+', '/', 'g') AS path, pos FROM l WHERE raw NOT LIKE '%/../%'),
f AS (SELECT path, min(pos) AS pos FROM n GROUP BY path) SELECT ino, f.path, row_number() OVER (ORDER BY pos) - 1 AS order_index FROM f JOIN e ON e.path = f.path""",
)
def s02(spark, d):
    docs = table(spark, d, "documents")
    from ..scale import numbered

    listed = numbered(docs.select("doc_id", "lang", "source", (F.col("doc_id") % 97).alias("_k")), ["_k", "doc_id"], "pos")
    listed = listed.select(F.concat(F.lit("/"), "lang", F.lit("/./"), "source", F.lit("//"), F.col("doc_id").cast("string")).alias("raw"), "pos")
    listed = listed.unionByName(spark.createDataFrame([("/../outside", -1)], "raw string, pos long"))
    inside = listed.where(~F.col("raw").contains("/../")).select(F.regexp_replace(F.replace("raw", F.lit("/./"), F.lit("/")), "/+", "/").alias("path"), "pos")
    first = inside.groupBy("path").agg(F.min("pos").alias("pos")).join(entries(spark, d).select("ino", "path"), "path")
    return numbered(first, ["pos"], "order_index").select("ino", "path", "order_index")


@query("s03_admission", f"WITH {ENTRIES} SELECT ino, CASE WHEN mode & 256 = 0 THEN 'unreadable' WHEN size = 0 THEN 'empty' ELSE 'file' END AS admitted FROM e")
def s03(spark, d):
    e = entries(spark, d)
    return e.select("ino", F.when(F.col("mode").bitwiseAND(F.lit(0o400)) == 0, "unreadable").when(F.col("size") == 0, "empty").otherwise("file").alias("admitted"))


@query("s06_header_bytes", "SELECT doc_id, left(text, 16) AS header FROM documents")
def s06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 16).alias("header"))


@query(
    "s08_extent_scan",
    f"""WITH {CHUNKS}, x AS (SELECT file, ord, hole, greatest("offset", 20) AS a, least("offset" + size, 80) AS b FROM c) SELECT file, ord, CASE WHEN hole THEN 'hole' ELSE 'data' END AS kind, a AS "offset", b - a AS length FROM x WHERE a < b""",
)
def s08(spark, d):
    from ..operators.sequences import overlaps

    c = chunks(spark, d).withColumn("stop", F.col("offset") + F.col("size"))
    cut = overlaps(c, "offset", "stop", F.lit(20), F.lit(80))
    return cut.select("file", "ord", F.when(F.col("hole"), "hole").otherwise("data").alias("kind"), F.col("cut_start").alias("offset"), (F.col("cut_end") - F.col("cut_start")).alias("length"))


@query(
    "s09_segment_scan",
    """SELECT doc_id, k AS "offset", length(substr(text, k + 1, 1024)) AS length, md5(substr(text, k + 1, 1024)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 64, 1), 960)) AS k FROM documents WHERE length(text) > 0)""",
)
def s09(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    # one pass over a text gives its strides of 960 characters and the 64 after each
    stride = F.lit(r"(?s)(.{1,960})(?=(.{0,64}))")
    pairs = F.arrays_zip(F.regexp_extract_all("text", stride, 1).alias("own"), F.regexp_extract_all("text", stride, 2).alias("more"))
    pieces = docs.select("doc_id", F.greatest(F.length("text") - 64, F.lit(1)).alias("end"), F.posexplode(pairs).alias("k", "p")).where("k * 960 < end")
    piece = F.concat("p.own", "p.more")
    return pieces.select("doc_id", (F.col("k") * 960).cast("long").alias("offset"), F.length(piece).cast("long").alias("length"), F.md5(piece.cast("binary")).alias("digest"))


@query("s11_hollow", f"WITH {ENTRIES} SELECT ino, size, 'hole' AS kind, 0 AS allocated FROM e")
def s11(spark, d):
    return entries(spark, d).select("ino", "size", F.lit("hole").alias("kind"), F.lit(0).alias("allocated"))


@query("k02_section_checksum", "SELECT source, count(*) AS parts, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def k02(spark, d):
    digests = table(spark, d, "documents").select("source", F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "")
    return digests.groupBy("source").agg(F.count("*").alias("parts"), F.sha2(joined.cast("binary"), 256).alias("digest"))


@query(
    "k03_section_index",
    f"""WITH {ENTRIES}, s AS (SELECT ino, ino % 4 AS kind, size, sum(size + 64) OVER (ORDER BY ino) - size - 64 AS pos FROM e) SELECT ino AS number, CAST((kind::HUGEINT * 281474976710656) + pos AS BIGINT) AS entry FROM s""",
)
def k03(spark, d):
    from ..scale import running

    s = running(entries(spark, d).select("ino", "size"), ["ino"], {"at": F.col("size") + 64}, inclusive=False)
    return s.select(F.col("ino").alias("number"), F.shiftleft((F.col("ino") % 4).cast("long"), 48).bitwiseOR(F.col("at").cast("long")).alias("entry"))


@query("k05_history_append", "SELECT c_custkey AS version, 'build' AS system, c_name AS arguments FROM customer UNION ALL SELECT max(c_custkey) + 1, 'rewrite', 'recompress' FROM customer")
def k05(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("version"), F.lit("build").alias("system"), F.col("c_name").alias("arguments"))
    return old.unionByName(c.agg((F.max("c_custkey") + 1).alias("version")).select("version", F.lit("rewrite").alias("system"), F.lit("recompress").alias("arguments")))


@query("k06_metadata_json", f"""WITH {ENTRIES} SELECT ino, '{{"ino":' || ino || ',"path":"' || path || '","size":' || size || '}}' AS json FROM e""")
def k06(spark, d):
    return entries(spark, d).select("ino", F.to_json(F.struct("ino", "path", "size")).alias("json"))


@query(
    "k07_extract_order",
    f"""WITH {CHUNKS}, f AS (SELECT file, arg_min(block, ord) AS first_block FROM c GROUP BY file) SELECT file, first_block, row_number() OVER (ORDER BY first_block, file) - 1 AS position FROM f""",
)
def k07(spark, d):
    from ..scale import numbered

    return numbered(chunks(spark, d).groupBy("file").agg(F.min_by("block", "ord").alias("first_block")), ["first_block", "file"], "position")


@query(
    "k08_extract_selection",
    f"""WITH {TREE}, {UP}, m AS (SELECT DISTINCT path FROM t WHERE regexp_matches(path, '^(?:.*/en/[^/]*)$')),
a AS (SELECT DISTINCT '/' || array_to_string(p[:k], '/') AS path FROM (SELECT string_split(path[2:], '/') AS p, unnest(range(1, len(string_split(path[2:], '/')) + 1)) AS k FROM m))
SELECT path, path IN (SELECT path FROM m) AS matched FROM a""",
)
def k08(spark, d):
    paths = tree(spark, d).select("path").distinct()
    matched = paths.where(globbing.matches_any(F.col("path"), ["**/en/*"]))
    up = matched.select(F.explode(T.ancestors(F.col("path"), itself=True)).alias("path")).distinct()
    return up.join(matched.withColumn("matched", F.lit(True)), "path", "left").select("path", F.coalesce("matched", F.lit(False)).alias("matched"))


@query(
    "k09_extract_bytes",
    f"""WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY ino) AS k FROM e) SELECT parent, CAST(sum(CASE WHEN k = 1 THEN size ELSE 0 END) AS BIGINT) AS bytes, count(*) AS files FROM r GROUP BY parent""",
)
def k09(spark, d):
    e = entries(spark, d).select("ino", "parent", "size", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = e.groupBy("h").agg(F.min("ino").alias("first"))
    return e.join(first, "h").groupBy("parent").agg(F.sum(F.when(F.col("ino") == F.col("first"), F.col("size")).otherwise(0)).alias("bytes"), F.count("*").alias("files"))


@query("k10_skip_specials", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'scroll')")
def k10(spark, d):
    return table(spark, d, "events").where(~F.col("event_type").isin("error", "scroll")).select("event_id", "event_type")


@query("k11_error_counts", f"WITH {ENTRIES} SELECT parent, count(*) FILTER (WHERE mode & 2048 <> 0 OR mode & 128 = 0) AS soft_errors, count(*) FILTER (WHERE size = 0) AS hard_errors FROM e GROUP BY parent")
def k11(spark, d):
    m = F.col("mode")
    soft = (m.bitwiseAND(F.lit(2048)) != 0) | (m.bitwiseAND(F.lit(128)) == 0)
    return entries(spark, d).groupBy("parent").agg(F.count_if(soft).alias("soft_errors"), F.count_if(F.col("size") == 0).alias("hard_errors"))


def _perm_sql(mode: str) -> str:
    return " || ".join(f"CASE WHEN {mode} & {0o400 >> k} <> 0 THEN '{'rwx'[k % 3]}' ELSE '-' END" for k in range(9))


@query("k12_listing", f"WITH {ENTRIES} SELECT ino, '-' || {_perm_sql('mode')} || ' ' || uid || '/' || gid || ' ' || lpad(CAST(size AS VARCHAR), 12, ' ') || ' ' || path AS line FROM e")
def k12(spark, d):
    m = F.col("mode")
    line = F.concat(modes.type_letter(m), modes.permission_string(m), F.lit(" "), F.col("uid").cast("string"), F.lit("/"), F.col("gid").cast("string"), F.lit(" "), F.lpad(F.col("size").cast("string"), 12, " "), F.lit(" "), "path")
    return entries(spark, d).select("ino", line.alias("line"))


@query("k13_checksum_listing", f"WITH {ENTRIES} SELECT sha256(text) || '  ' || path AS line FROM e")
def k13(spark, d):
    return entries(spark, d).select(F.concat(checksum(F.col("text").cast("binary")), F.lit("  "), "path").alias("line"))


RULES = """
# only two languages, but of English no odd sources
+ /en/src1*
- /en/src?/**
i- /FR/*/[0-4]*
+ *7
- /{de,es}/**
"""
_RULES = "\n".join(line.replace("i-", "-i") for line in RULES.strip().splitlines())


def _rules_sql(path: str) -> str:
    out = "true"
    for r in reversed(globbing.parse_rules(_RULES)):
        out = f"CASE WHEN regexp_matches({path}, '{r.pattern}') THEN {str(r.keep).lower()} ELSE {out} END"
    return out


@query("f01_filter_rules", f"WITH {ENTRIES} SELECT path, {_rules_sql('path')} AS kept FROM e")
def f01(spark, d):
    return entries(spark, d).select("path", globbing.kept_by(F.col("path"), globbing.parse_rules(_RULES)).alias("kept"))


@query("f02_merge_rules", f"WITH {ENTRIES} SELECT path FROM e WHERE {_rules_sql('path')}")
def f02(spark, d):
    return entries(spark, d).where(globbing.kept_by(F.col("path"), globbing.parse_rules(". shared", {"shared": _RULES}.__getitem__))).select("path")


GLOBS = ["/en/**", "/{fr,de}/src[!0-4]/*", "/es/src1?/*[02468]", "i:/FR/SRC1/*", "*"]


@query("f03_globs", f"WITH {ENTRIES} SELECT path, " + ", ".join(f"regexp_matches(path, '{globbing.anchored(g.removeprefix('i:'), g.startswith('i:'))}') AS g{k}" for k, g in enumerate(GLOBS)) + " FROM e")
def f03(spark, d):
    return entries(spark, d).select("path", *(globbing.matches_any(F.col("path"), [g]).alias(f"g{k}") for k, g in enumerate(GLOBS)))


@query("f04_multi_glob", f"WITH {ENTRIES} SELECT path FROM e WHERE " + " OR ".join(f"regexp_matches(path, '{globbing.anchored(g.removeprefix('i:'), g.startswith('i:'))}')" for g in GLOBS[1:4]))
def f04(spark, d):
    return entries(spark, d).where(globbing.matches_any(F.col("path"), GLOBS[1:4])).select("path")


@query(
    "f05_prune",
    f"""WITH {TREE}, {UP}, bad AS (SELECT path FROM nodes WHERE regexp_matches(path, '^/[^/]*/(fr|de)$'))
SELECT path, is_dir FROM nodes WHERE path NOT IN (SELECT path FROM bad) AND NOT EXISTS (SELECT 1 FROM bad WHERE starts_with(nodes.path, bad.path || '/'))""",
)
def f05(spark, d):
    return T.prune(T.scan_tree(tree(spark, d)), ~F.col("path").rlike("^/[^/]*/(fr|de)$")).select("path", "is_dir")


@query(
    "f06_remove_empty_dirs",
    f"""WITH {TREE}, {UP}, kept AS (SELECT path, is_dir FROM nodes WHERE is_dir OR regexp_matches(path, '/[0-4][0-9]*$'))
SELECT path, is_dir FROM kept WHERE NOT is_dir OR EXISTS (SELECT 1 FROM kept k WHERE NOT k.is_dir AND starts_with(k.path, kept.path || '/'))""",
)
def f06(spark, d):
    nodes = T.scan_tree(tree(spark, d)).select("path", "is_dir").where(F.col("is_dir") | F.col("path").rlike("/[0-4][0-9]*$"))
    return T.without_empty_dirs(nodes)


#: Mode: kept entries, dropped entries, directories, marks.
_DEBUG = {"included": (1, 0, 1, 0), "excluded": (0, 1, 1, 0), "all": (1, 1, 1, 1), "included-files": (1, 0, 0, 0), "excluded-files": (0, 1, 0, 0), "files": (1, 1, 0, 1)}


@query(
    "f07_debug_filter",
    f"""WITH {ENTRIES}, x AS (SELECT path, false AS dir, {_rules_sql('path')} AS keep FROM e UNION ALL SELECT path, true, {_rules_sql('path')} FROM (SELECT DISTINCT parent AS path FROM e)),
m AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {', '.join(map(str, v))})" for m, v in _DEBUG.items())}) AS m(mode, kept, dropped, dirs, marks))
SELECT mode, CASE WHEN marks = 0 THEN '' WHEN keep THEN '+ ' ELSE '- ' END || path AS line FROM x JOIN m ON (CASE WHEN keep THEN kept ELSE dropped END) = 1 AND (dirs = 1 OR NOT dir)""",
)
def f07(spark, d):
    e = entries(spark, d)
    both = e.select("path", F.lit(False).alias("dir")).unionAll(e.select(F.col("parent").alias("path"), F.lit(True).alias("dir")).distinct())
    both = both.withColumn("keep", globbing.kept_by(F.col("path"), globbing.parse_rules(_RULES)))
    shown = [
        F.when((F.col("keep") if kept and not dropped else ~F.col("keep") if dropped and not kept else F.lit(True)) & (F.lit(bool(dirs)) | ~F.col("dir")),
               F.struct(F.lit(mode).alias("mode"), F.concat(F.when(F.col("keep"), "+ ").otherwise("- ") if marks else F.lit(""), "path").alias("line")))
        for mode, (kept, dropped, dirs, marks) in _DEBUG.items()
    ]
    return both.select(F.explode(F.array_compact(F.array(*shown))).alias("x")).select("x.mode", "x.line")


@query(
    "f08_access",
    f"""WITH {ENTRIES} SELECT ino, ((CASE WHEN uid = 1001 THEN (mode >> 6) & 7 ELSE 0 END) | (CASE WHEN gid = 100 THEN (mode >> 3) & 7 ELSE 0 END) | (mode & 7)) & 2 = 2 AS may_write,
(CASE WHEN mode & 73 <> 0 THEN 7 ELSE 6 END) & 1 = 1 AS root_may_run FROM e""",
)
def f08(spark, d):
    args = F.col("mode"), F.col("uid"), F.col("gid")
    return entries(spark, d).select("ino", modes.may_access(*args, 2, 1001, 100).alias("may_write"), modes.may_access(*args, 1, 0, 0).alias("root_may_run"))


@query("f09_read_only_mask", f"WITH {ENTRIES} SELECT ino, mode & ~146 AS mode FROM e")
def f09(spark, d):
    return entries(spark, d).select("ino", F.col("mode").bitwiseAND(F.lit(~0o222)).alias("mode"))


@query("f10_requirements", "SELECT p_partkey, p_brand IN ('Brand#2', 'Brand#11') AND p_size BETWEEN 5 AND 30 AS fits FROM part")
def f10(spark, d):
    from ..operators.requirements import satisfies

    return table(spark, d, "part").select("p_partkey", satisfies({"p_brand": ["set", ["Brand#2", "Brand#11"]], "p_size": ["range", 5, 30]}, {"p_brand", "p_size"}).alias("fits"))


@query("f11_unsupported_features", "SELECT c_custkey, array_to_string(list_sort(list_filter(string_split(lower(c_mktsegment || ',AUTOMOBILE'), ','), lambda x: x NOT IN ('building', 'machinery'))), ',') AS unsupported FROM customer")
def f11(spark, d):
    wanted = F.split(F.lower(F.concat("c_mktsegment", F.lit(",AUTOMOBILE"))), ",")
    rest = F.filter(wanted, lambda x: ~x.isin("building", "machinery"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(rest), ",").alias("unsupported"))


@query("f12_recompress_set", f"WITH {CHUNKS} SELECT file, ord, category, category NOT IN ('A') AS recompress FROM c")
def f12(spark, d):
    from ..operators.requirements import selected_categories

    return chunks(spark, d).select("file", "ord", "category", selected_categories(F.col("category"), "!A").alias("recompress"))


@query("f13_chmod", f"WITH {ENTRIES} SELECT ino, mode & 4095 AS old_mode, (mode & 4095 | 64) & ~((mode & 4095) & 7) | (((mode & 4095 | 64) >> 3) & 7) AS new_mode FROM e")
def f13(spark, d):
    m = F.col("mode").bitwiseAND(F.lit(0o7777))
    return entries(spark, d).select("ino", m.alias("old_mode"), modes.chmod(m, F.lit(False), "u+x,o=g").alias("new_mode"))


@query("f14_override", f"WITH {ENTRIES} SELECT ino, 0 AS uid, 0 AS gid, 1700000000 AS mtime FROM e")
def f14(spark, d):
    return entries(spark, d).select("ino", F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(1700000000).alias("mtime"))
