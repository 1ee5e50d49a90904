"""Aggregates and reports (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.units import bit_width
from ..operators import dedup, hamming
from ..operators.sketches import exact_quantiles
from ..sources.content import CHUNKS, ENTRIES, TREE, VECTORS, chunks, entries, table, trace, tree, vectors
from .registry import query
from .scan_queries import UP


@query("a01_unique_inodes", "SELECT c_nationkey AS dev, c_custkey % 50 AS ino, min(c_name) AS path FROM customer GROUP BY ALL")
def a01(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("dev"), (F.col("c_custkey") % 50).alias("ino")).agg(F.min("c_name").alias("path"))


@query("a02_content_dedup", f"WITH {ENTRIES} SELECT sha256(text) AS digest, size, count(*) AS copies, min(path) AS first FROM e GROUP BY ALL HAVING count(*) > 1")
def a02(spark, d):
    return dedup.content_groups(entries(spark, d))


@query("a03_dedup_savings", f"WITH {ENTRIES}, g AS (SELECT size, count(*) AS n FROM e GROUP BY size, sha256(text) HAVING count(*) > 1) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_files, CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS saved_by_deduplication FROM g")
def a03(spark, d):
    return dedup.savings(dedup.content_groups(entries(spark, d)))


@query("a04_fragment_info", f"WITH {CHUNKS} SELECT category, block AS subcategory, count(*) AS fragments, CAST(sum(size) AS BIGINT) AS total_size, row_number() OVER (ORDER BY sum(size) DESC, category, block) AS position FROM c GROUP BY category, block")
def a04(spark, d):
    g = chunks(spark, d).groupBy("category", F.col("block").alias("subcategory")).agg(F.count("*").alias("fragments"), F.sum("size").alias("total_size"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.desc("total_size"), "category", "subcategory")).cast("long"))  # a row a category


@query("a05_category_report", f"WITH {CHUNKS} SELECT category, count(DISTINCT block) AS blocks, CAST(sum(size) AS BIGINT) AS size, CAST(coalesce(sum(size) FILTER (WHERE NOT hole), 0) AS BIGINT) AS stored FROM c GROUP BY category")
def a05(spark, d):
    return chunks(spark, d).groupBy("category").agg(F.countDistinct("block").alias("blocks"), F.sum("size").alias("size"), F.sum(F.when(~F.col("hole"), F.col("size")).otherwise(0)).alias("stored"))


@query(
    "a06_image_totals",
    f"""WITH {CHUNKS}, f AS (SELECT file, sum(size) AS size, sum(CASE WHEN hole THEN 0 ELSE size END) AS allocated, count(*) AS n FROM c GROUP BY file)
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(allocated) AS BIGINT) AS total_allocated, count(*) FILTER (WHERE n >= 6) AS cached_sizes FROM f""",
)
def a06(spark, d):
    f = chunks(spark, d).groupBy("file").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("hole"), 0).otherwise(F.col("size"))).alias("allocated"), F.count("*").alias("n"))
    return f.agg(F.count("*").alias("files"), F.sum("size").alias("total_size"), F.sum("allocated").alias("total_allocated"), F.count_if(F.col("n") >= 6).alias("cached_sizes"))


@query("a07_nlink", f"WITH {ENTRIES} SELECT min(ino) AS ino, count(*) - 1 AS nlink_minus_one FROM e GROUP BY sha256(text)")
def a07(spark, d):
    return entries(spark, d).groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("ino").alias("ino"), (F.count("*") - 1).alias("nlink_minus_one")).select("ino", "nlink_minus_one")


@query(
    "a08_chunk_analysis",
    f"""WITH {CHUNKS}, f AS (SELECT file, count(*) AS n, count(DISTINCT block) AS blocks FROM c GROUP BY file), m AS (SELECT count(*) AS mergeable FROM (SELECT block = lag(block) OVER (PARTITION BY file ORDER BY ord) AS same FROM c) WHERE same)
SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99, max(n) AS most, max(blocks) AS most_blocks, max(mergeable) AS mergeable FROM f, m""",
)
def a08(spark, d):
    c = chunks(spark, d)
    same = F.lag("block").over(Window.partitionBy("file").orderBy("ord")) == F.col("block")
    m = c.select(same.alias("same")).agg(F.count_if("same").alias("mergeable"))
    f = c.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"))
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("long").alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return f.agg(*exact, F.max("n").alias("most"), F.max("blocks").alias("most_blocks")).join(m)  # one row each


QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query("a09_quantiles", "SELECT event_type, quantile_disc(user_id, 0.5) AS p50, quantile_disc(user_id, 0.9) AS p90, quantile_disc(user_id, 0.99) AS p99 FROM events GROUP BY event_type")
def a09(spark, d):
    return exact_quantiles(table(spark, d, "events"), "event_type", "user_id", QUANTILES)


@query("a09_quantile_sketch")
def a09_sketch(spark, d):
    from ..operators.sketches import quantile_sketch

    return quantile_sketch(table(spark, d, "events"), "event_type", "user_id", [0.5, 0.9, 0.99])


@query("a10_statvfs", f"WITH {ENTRIES} SELECT CAST(sum((size + 511) // 512) AS BIGINT) AS blocks, count(*) AS files, max(length(name)) AS name_max FROM e")
def a10(spark, d):
    return entries(spark, d).agg(F.sum(F.expr("(size + 511) div 512")).alias("blocks"), F.count("*").alias("files"), F.max(F.length("name")).cast("long").alias("name_max"))


@query("a11_size_info", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, bool_or(nullif(l_discount, 0) IS NULL) AS estimate FROM lineitem GROUP BY l_returnflag")
def a11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("size"), F.bool_or(F.nullif("l_discount", F.lit(0.0)).isNull()).alias("estimate"))


@query("a12_latency_summary", "SELECT event_type, count(*) AS samples, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, quantile_disc(CAST(round(value * 100) AS BIGINT), 0.5) AS p50, quantile_disc(CAST(round(value * 100) AS BIGINT), 0.9) AS p90, quantile_disc(CAST(round(value * 100) AS BIGINT), 0.99) AS p99 FROM events GROUP BY event_type")
def a12(spark, d):
    v = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    sums = v.groupBy("event_type").agg(F.count("*").alias("samples"), F.sum("v").alias("total"))
    return sums.join(exact_quantiles(v, "event_type", "v", QUANTILES), "event_type")


@query("a13_top_buckets", "SELECT lang, bucket, n, rank FROM (SELECT lang, length(text) % 16 AS bucket, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, length(text) % 16) AS rank FROM documents GROUP BY lang, length(text) % 16) WHERE rank <= 4")
def a13(spark, d):
    g = table(spark, d, "documents").groupBy("lang", (F.length("text") % 16).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bucket")).cast("long")).where("rank <= 4")


@query("a14_centroid", f"WITH {VECTORS}, b AS (SELECT label, k, sum((bits >> k) & 1) AS ones, count(*) AS n FROM v, range(63) r(k) GROUP BY label, k) SELECT label, any_value(n) AS n, CAST(sum(CASE WHEN ones > n // 2 THEN 1::BIGINT << k ELSE 0 END) AS BIGINT) AS centroid FROM b GROUP BY label")
def a14(spark, d):
    return hamming.centroid(vectors(spark, d), "label", width=63)


@query("a15_unused_bits", f"WITH {ENTRIES} SELECT parent, bit_or(size * 8) AS folded, CASE WHEN bit_or(size * 8) = 0 THEN 0 ELSE length(regexp_extract(bin(bit_or(size * 8)), '0*$', 0)) END AS unused FROM e GROUP BY parent")
def a15(spark, d):
    folded = entries(spark, d).groupBy("parent").agg(F.bit_or(F.col("size") * 8).alias("folded"))
    return folded.withColumn("unused", F.when(F.col("folded") == 0, 0).otherwise(F.length(F.regexp_extract(F.bin("folded"), "0*$", 0))).cast("long"))


@query("a16_largest_chunk", f"WITH {CHUNKS} SELECT category, max(size) FILTER (WHERE NOT hole) AS largest FROM c GROUP BY category")
def a16(spark, d):
    return chunks(spark, d).groupBy("category").agg(F.max(F.when(~F.col("hole"), F.col("size"))).alias("largest"))


@query("a17_metadata_space", f"""WITH {CHUNKS}, m AS (SELECT count(*) AS n, max(size) AS s, max(block) AS b, max("offset") AS o FROM c) SELECT field, bits, bits * n AS total_bits FROM (SELECT n, unnest(['size', 'block', 'offset']) AS field, unnest([length(bin(s)), length(bin(b)), length(bin(o))]) AS bits FROM m)""")
def a17(spark, d):
    m = chunks(spark, d).agg(F.count("*").alias("n"), *(F.max(f).alias(f) for f in ("size", "block", "offset")))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), bit_width(F.col(f)).cast("long").alias("bits")) for f in ("size", "block", "offset")))).alias("r")
    return m.select("n", rows).select("r.field", "r.bits", (F.col("r.bits") * F.col("n")).alias("total_bits"))


@query("a18_ratio", f"WITH {CHUNKS} SELECT CAST(sum(CASE WHEN hole THEN 0 ELSE size END) AS BIGINT) AS stored, CAST(sum(size) AS BIGINT) AS total, sum(CASE WHEN hole THEN 0 ELSE size END) / sum(size) AS ratio FROM c")
def a18(spark, d):
    return chunks(spark, d).agg(F.sum(F.when(F.col("hole"), 0).otherwise(F.col("size"))).alias("stored"), F.sum("size").alias("total")).withColumn("ratio", F.col("stored") / F.col("total"))


@query("a19_child_counts", f"WITH {TREE}, {UP} SELECT regexp_replace(path, '/[^/]*$', '') AS parent, count(*) AS children FROM nodes GROUP BY 1")
def a19(spark, d):
    from ..operators.tree import scan_tree

    return scan_tree(tree(spark, d)).groupBy("parent").agg(F.count("*").alias("children"))


#: Microseconds of the rate's window.
_RATE_WINDOW = 6 * 3_600_000_000


@query(
    "t01_rate",
    f"""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us FROM events),
f AS (SELECT event_id, us, min({{'us': us, 'n': event_id}}) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN {_RATE_WINDOW} PRECEDING AND CURRENT ROW) AS first FROM e)
SELECT event_id, CASE WHEN (us - first.us) // 1000 > 0 THEN (1000 * (event_id - first.n)) // ((us - first.us) // 1000) ELSE 0 END AS rate FROM f""",
)
def t01(spark, d):
    from ..scale import first_from

    e = trace(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = first_from(e, "event_type", "us", "event_id", _RATE_WINDOW, "first")
    elapsed = F.expr("(us - first.us) div 1000")
    return first.select("event_id", F.when(elapsed > 0, F.expr("(1000 * (event_id - first.event_id)) div ((us - first.us) div 1000)")).otherwise(0).alias("rate"))


@query("t02_sequential_access", "SELECT user_id, event_id, b = 1 + lag(b) OVER w AND lag(b) OVER w = 1 + lag(b, 2) OVER w AS sequential FROM (SELECT user_id, event_id, ts, event_id // 150 AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def t02(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = trace(spark, d).withColumn("b", F.expr("event_id div 150"))
    one, two = F.lag("b").over(w), F.lag("b", 2).over(w)
    return e.select("user_id", "event_id", ((F.col("b") == one + 1) & (one == two + 1)).alias("sequential"))


@query(
    "t03_idle_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS accesses FROM s GROUP BY user_id, k""",
)
def t03(spark, d):
    e = trace(spark, d).withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("t", "6 hours").alias("s")).agg(F.unix_micros(F.min("t")).alias("first_us"), F.unix_micros(F.max("t")).alias("last_us"), F.count("*").alias("accesses"))
    return g.drop("s")


@query("q18_access_list", "SELECT user_id, epoch_us(min(ts)) AS first_us, row_number() OVER (ORDER BY min(ts), user_id) - 1 AS position FROM events GROUP BY user_id")
def q18(spark, d):
    from ..scale import numbered

    first = trace(spark, d).groupBy("user_id").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"))
    return numbered(first, ["first_us", "user_id"], "position")
