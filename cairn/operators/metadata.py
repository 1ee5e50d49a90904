"""The normalized metadata of an image as tables: how it is made from a file list, and its consistency checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lagged, numbered, running, written
from . import packing, sequences
from . import tree as T

#: The bits of a mode that tell the type, those of types by rank, the offset that marks a large hole, the longest name and link target.
TYPE_BITS = 0o170000
TYPES = {0o040000: 0, 0o120000: 1, 0o100000: 2, 0o060000: 3, 0o020000: 3, 0o010000: 4, 0o140000: 4}
LARGE_HOLE = 0xFFFFFFFF
MAX_NAME, MAX_LINK = 512, 4096


@dataclass(frozen=True)
class Metadata:
    """Tables by name, each with its index ``ix``, and the scalar options.

    inodes(mode_index, owner_index, group_index), directories(first_entry, parent_entry, self_entry) with a sentinel, dir_entries(name_index,
    inode_num), chunk_table(first_chunk) with a sentinel, chunks(block, offset, size), names/symlinks(value), modes/uids/gids(value),
    symlink_table(target), and, where there are any, shared_files(content), devices(value), large_holes(size).
    ``packed`` names tables among directories, chunk_table and shared_files that hold differences instead of positions.
    """

    tables: dict[str, DataFrame]
    block_size: int
    hole_block: int | None = None
    sparse: bool = False
    packed: frozenset = field(default_factory=frozenset)

    def with_tables(self, **changed: DataFrame) -> Metadata:
        return replace(self, tables=self.tables | changed)


def rank(mode: Column) -> Column:
    """0 directory, 1 link, 2 file, 3 device, 4 pipe or socket; null if none of them."""
    kinds = F.create_map(*(F.lit(v) for kv in TYPES.items() for v in kv))
    return F.try_element_at(kinds, mode.bitwiseAND(F.lit(TYPE_BITS)).cast("int"))


def normalized(files: DataFrame, block_size: int, dir_mode: int = 0o040755) -> Metadata:
    """Metadata of regular files (path, mode, uid, gid, size): directories breadth first, entries by directory and name, contents end to end.

    Every number is a rank over a whole table, made by range, so no task holds a table.  Paths must be distinct.
    """
    nodes = T.scan_tree(files.select("path"))
    made = nodes.where("is_dir").select("path", "parent", "name", "depth", F.lit(dir_mode).alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.lit(0).alias("_rank"))
    root = files.sparkSession.createDataFrame([("", None, None, 0, dir_mode, 0, 0, 0)], made.schema)
    own = files.select("path", T.parent(F.col("path")).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(0).cast("long").alias("depth"), F.col("mode").cast("int").alias("mode"), F.col("uid").cast("long").alias("uid"), F.col("gid").cast("long").alias("gid"), rank(F.col("mode")).alias("_rank"))
    # of files the path alone decides, so that contents lie in path order
    all_nodes = written(numbered(root.unionByName(made).unionByName(own), ["_rank", "depth", "path"], "ino"))

    kinds = {n: written(sequences.sorted_dictionary(all_nodes.select(F.col(c).alias("value")), "value")) for n, c in (("modes", "mode"), ("uids", "uid"), ("gids", "gid"))}
    names = written(sequences.sorted_dictionary(all_nodes.where("name IS NOT NULL").select(F.col("name").alias("value")), "value"))
    inodes = all_nodes
    for table, column, index in (("modes", "mode", "mode_index"), ("uids", "uid", "owner_index"), ("gids", "gid", "group_index")):
        inodes = inodes.join(kinds[table].select(F.col("value").alias(column), F.col("ix").alias(index)), column)

    parents = all_nodes.where("_rank = 0").select(F.col("path").alias("parent"), F.col("ino").alias("_dir"))
    placed = all_nodes.where("parent IS NOT NULL").join(parents, "parent").select("_dir", "name", "ino", "_rank")
    entries = numbered(placed, ["_dir", "name"], "ix").withColumn("ix", F.col("ix") + 1).join(names.select(F.col("value").alias("name"), F.col("ix").alias("name_index")), "name")
    zero = files.sparkSession.createDataFrame([(None, 0, 0, 0)], "_dir long, ix long, name_index long, inode_num long")
    entries = written(zero.unionByName(entries.select("_dir", "ix", "name_index", F.col("ino").alias("inode_num"))))
    first = entries.where("_dir IS NOT NULL").groupBy("_dir").agg(F.min("ix").alias("first_entry"))
    at = entries.select(F.col("inode_num").alias("_dir"), F.col("ix").alias("self_entry"), F.col("_dir").alias("_up")).join(first, "_dir")
    up = at.select(F.col("_dir").alias("_up"), F.col("self_entry").alias("parent_entry"))
    directories = at.join(up, "_up", "left").select(F.col("_dir").alias("ix"), "first_entry", F.coalesce("parent_entry", F.lit(0)).alias("parent_entry"), "self_entry")
    end = entries.agg(F.count("*").alias("first_entry")).join(first.agg(F.count("*").alias("ix")))  # one row each
    directories = directories.unionByName(end.select("ix", "first_entry", F.lit(0).cast("long").alias("parent_entry"), F.lit(0).cast("long").alias("self_entry")))

    sized = all_nodes.where("_rank = 2").select("ino", "path").join(files.select("path", F.col("size").cast("long").alias("size")), "path").select("ino", "size", F.lit(0).alias("stream"))
    parts = packing.repacked(sized, "stream", ["ino"], block_size)
    chunks = written(numbered(parts.select("ino", F.col("block").cast("long").alias("block"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size")), ["ino", "block"], "ix"))
    held = sized.select("ino").join(chunks.groupBy("ino").agg(F.count("*").alias("n")), "ino", "left").select("ino", F.coalesce("n", F.lit(0)).alias("n"))
    table = numbered(running(held, ["ino"], {"first_chunk": F.col("n")}, inclusive=False), ["ino"], "ix").select("ix", "first_chunk")
    stop = chunks.agg(F.count("*").alias("first_chunk")).join(held.agg(F.count("*").alias("ix")))  # one row each
    none = files.sparkSession.createDataFrame([], "ix long, value string")
    tables = {
        "inodes": inodes.select(F.col("ino").alias("ix"), "mode_index", "owner_index", "group_index"), "directories": directories, "dir_entries": entries.drop("_dir"),
        "chunk_table": table.unionByName(stop.select("ix", "first_chunk")), "chunks": chunks.drop("ino"), "names": names, "symlinks": none,
        "symlink_table": none.select("ix", F.lit(0).cast("long").alias("target")), **kinds,
    }
    return Metadata({n: df if n in (*kinds, "names") else written(df) for n, df in tables.items()}, block_size)


def consistency(meta: Metadata) -> DataFrame:
    """Violations (family, rule, id) of the seven families of checks; id is the index of the row at fault, null where a table as a whole is.

    All faults are listed, not the first alone.  Only the number of rows of each table comes to the driver.  Chunks of a hole block may have any
    offset but the mark of a large hole; indices beyond a dictionary belong to no type, so partitions and counts leave them out.
    """
    t = meta.tables
    optional = [n for n in ("shared_files", "devices", "large_holes") if n in t]
    n = {name: df.count() for name, df in t.items()}
    spark = t["inodes"].sparkSession
    whole: list[tuple[str, str, None]] = []
    found: list[DataFrame] = []
    asked: dict[str, list] = {}

    def say(family: str, rule: str, wrong: bool) -> None:
        if wrong:
            whole.append((family, rule, None))

    def rows(family: str, rule: str, name: str, wrong: Column) -> None:
        asked.setdefault(name, []).append(F.when(wrong, F.struct(F.lit(family).alias("family"), F.lit(rule).alias("rule"))))

    def descends(family: str, rule: str, df: DataFrame, value: str) -> None:
        down = lagged(df.select("ix", value), value, ["ix"], "_before", -1).where(F.col("_before") > F.col(value))
        found.append(down.select(F.lit(family).alias("family"), F.lit(rule).alias("rule"), F.col("ix").cast("long").alias("id")))

    def one(df: DataFrame, what: Column) -> int:
        return df.agg(what.alias("v")).first()["v"] or 0

    for name in ("inodes", "directories", "chunk_table", "dir_entries", "modes"):
        say("empty tables", name, n[name] == 0)

    for name in ("modes", "uids", "gids"):
        say("index ranges", f"number of {name}", n[name] > n["inodes"])
    say("index ranges", "number of names", n["names"] > n["dir_entries"])
    say("index ranges", "number of inodes", n["inodes"] > n["dir_entries"])
    say("index ranges", "number of dir_entries", n["dir_entries"] >= 0xFFFFFFFF)
    rows("index ranges", "mode_index", "inodes", F.col("mode_index") >= n["modes"])
    # no table of owners or groups: the index is the owner itself
    for index, name in (("owner_index", "uids"), ("group_index", "gids")):
        if n[name]:
            rows("index ranges", index, "inodes", F.col(index) >= n[name])
    rows("index ranges", "name_index", "dir_entries", (F.col("name_index") >= n["names"]) & (F.col("name_index") > 0))
    rows("index ranges", "inode_num", "dir_entries", F.col("inode_num") >= n["inodes"])

    dirs, entries = t["directories"], n["dir_entries"]
    say("packed tables", "number of directories", n["directories"] > n["inodes"] + 1)
    say("packed tables", "number of chunk_table entries", n["chunk_table"] > n["inodes"])
    if "directories" in meta.packed:
        for c in ("parent_entry", "self_entry"):
            rows("packed tables", f"{c} in packed directory", "directories", F.col(c) != 0)
        say("packed tables", "sum of first_entry", one(dirs, F.sum("first_entry")) != entries)
    else:
        f, p, s, ix = F.col("first_entry"), F.col("parent_entry"), F.col("self_entry"), F.col("ix")
        outer = (ix == 0) | (ix == n["directories"] - 1)
        descends("packed tables", "first_entry not sorted", dirs, "first_entry")
        rows("packed tables", "first_entry out of range", "directories", f > entries)
        rows("packed tables", "self_entry out of range", "directories", s > entries)
        rows("packed tables", "parent_entry out of range", "directories", p >= entries)
        rows("packed tables", "first_entry is parent_entry", "directories", f == p)
        rows("packed tables", "parent_entry of root", "directories", outer & (p != 0))
        rows("packed tables", "self_entry of root", "directories", (ix == 0) & (s != 0))
        rows("packed tables", "first_entry is self_entry", "directories", ~outer & (f == s))
        rows("packed tables", "self_entry is parent_entry", "directories", ~outer & (s == p))
    if "chunk_table" in meta.packed:
        say("packed tables", "sum of chunk_table", one(t["chunk_table"], F.sum("first_chunk")) != n["chunks"])
    else:
        descends("packed tables", "chunk_table not sorted", t["chunk_table"], "first_chunk")
        say("packed tables", "end of chunk_table", n["chunk_table"] > 0 and one(t["chunk_table"], F.max_by("first_chunk", "ix")) != n["chunks"])

    said = one(t["dir_entries"], F.max("name_index")) + 1 if entries > 1 else 0
    say("string tables", "number of names", n["names"] != said)
    rows("string tables", "length of name", "names", F.octet_length("value") > MAX_NAME)
    say("string tables", "number of symlinks", n["symlinks"] != (one(t["symlink_table"], F.max("target")) + 1 if n["symlink_table"] else 0))
    rows("string tables", "length of symlink", "symlinks", F.octet_length("value") > MAX_LINK)

    b, o, s = F.col("block"), F.col("offset"), F.col("size")
    say("chunks", "hole block without feature", meta.hole_block is not None and not meta.sparse)
    say("chunks", "feature without hole block", meta.hole_block is None and meta.sparse)
    say("chunks", "block size", meta.block_size < 1 or meta.block_size & (meta.block_size - 1) != 0)
    hole = (b == meta.hole_block) if meta.sparse and meta.hole_block is not None else F.lit(False)
    rows("chunks", "large hole index", "chunks", hole & (o == LARGE_HOLE) & (s >= n.get("large_holes", 0)))
    rows("chunks", "offset", "chunks", ~hole & (o >= meta.block_size))
    rows("chunks", "size", "chunks", ~hole & (s > meta.block_size))
    rows("chunks", "end", "chunks", ~hole & (o + s > meta.block_size))

    ranked = t["inodes"].select("ix", "mode_index").join(t["modes"].select(F.col("ix").alias("mode_index"), rank(F.col("value")).alias("_rank")), "mode_index").where("_rank IS NOT NULL")
    descends("partitioning", "inodes", ranked, "_rank")

    has = {r["_rank"]: r["n"] for r in ranked.groupBy("_rank").agg(F.count("*").alias("n")).collect()}  # five rows at most
    unique, shared = n["chunk_table"] - 1, 0
    if "shared_files" in optional and n["shared_files"]:
        if "shared_files" in meta.packed:
            unique, shared = unique - n["shared_files"], one(t["shared_files"], F.sum("content")) + 2 * n["shared_files"]
        else:
            descends("counts", "shared_files not sorted", t["shared_files"], "content")
            unique, shared = unique - one(t["shared_files"], F.max_by("content", "ix")) - 1, n["shared_files"]
    say("counts", "directories", n["directories"] - 1 != has.get(0, 0))
    say("counts", "links", n["symlink_table"] != has.get(1, 0))
    say("counts", "files", unique + shared != has.get(2, 0))
    say("counts", "devices", n.get("devices", 0) != has.get(3, 0))
    # one pass over each table answers all its rules
    for name, wrong in asked.items():
        found.append(t[name].select(F.col("ix").cast("long").alias("id"), F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("_w")).select("_w.family", "_w.rule", "id"))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame(whole, "family string, rule string, id long"))
