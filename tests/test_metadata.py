"""Normalized metadata and its checks, on a tree of three files."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cairn.operators.checking import section_errors
from cairn.operators.metadata import consistency, normalized

FILES = [("/a/x", 0o100644, 5, 7, 10), ("/a/y", 0o100600, 5, 7, 0), ("/b/x", 0o100644, 6, 7, 70)]


@pytest.fixture(scope="module")
def meta(spark):
    return normalized(spark.createDataFrame(FILES, "path string, mode int, uid long, gid long, size long"), 64)


def rows(df):
    return {r["ix"]: tuple(v for k, v in r.asDict().items() if k != "ix") for r in df.collect()}


def test_tables_of_a_small_tree(meta):
    t = meta.tables
    assert rows(t["names"]) == {0: ("a",), 1: ("b",), 2: ("x",), 3: ("y",)}
    assert rows(t["dir_entries"].select("ix", "name_index", "inode_num")) == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (2, 3), 4: (3, 4), 5: (2, 5)}
    assert rows(t["directories"].select("ix", "first_entry", "parent_entry", "self_entry")) == {0: (1, 0, 0), 1: (3, 0, 1), 2: (5, 0, 2), 3: (6, 0, 0)}
    assert rows(t["chunk_table"]) == {0: (0,), 1: (1,), 2: (1,), 3: (3,)}
    assert rows(t["chunks"].select("ix", "block", "offset", "size")) == {0: (0, 0, 10), 1: (0, 10, 54), 2: (1, 0, 16)}


def test_empty_and_packed_tables(spark, meta):
    t = meta.tables
    gone = meta.with_tables(modes=t["modes"].limit(0), inodes=t["inodes"].limit(0))
    found = {(r["family"], r["rule"], r["id"]) for r in consistency(gone).collect()}
    assert {("empty tables", "inodes", None), ("empty tables", "modes", None), ("index ranges", "number of uids", None), ("counts", "files", None)} <= found
    assert not {f for f in found if f[:2] == ("empty tables", "directories")}
    # first entries and chunk counts as differences
    packed = meta.with_tables(
        directories=spark.createDataFrame([(0, 1, 0, 0), (1, 2, 0, 0), (2, 2, 0, 0), (3, 1, 0, 0)], t["directories"].select("ix", "first_entry", "parent_entry", "self_entry").schema),
        chunk_table=spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 1)], t["chunk_table"].schema),
    )
    found = consistency(replace(packed, packed=frozenset({"directories", "chunk_table"}), sparse=True, block_size=48)).collect()
    assert {tuple(r) for r in found} == {
        ("packed tables", "sum of chunk_table", None), ("chunks", "feature without hole block", None), ("chunks", "block size", None),
        ("chunks", "size", 1), ("chunks", "end", 1),
    }


def test_shared_files_count_beside_unique_ones(spark, meta):
    t = meta.tables
    # two of the three files share one content, so there are two contents
    shared = {"shared_files": spark.createDataFrame([(0, 0), (1, 0)], "ix long, content long"), "chunk_table": t["chunk_table"].where("ix != 1").withColumn("ix", F.when(F.col("ix") > 1, F.col("ix") - 1).otherwise(F.col("ix")))}
    assert consistency(meta.with_tables(**shared)).collect() == []
    packed = meta.with_tables(**(shared | {"shared_files": spark.createDataFrame([(0, 0)], "ix long, content long")}))
    assert consistency(replace(packed, packed=frozenset({"shared_files"}))).collect() == []


def test_levels_of_the_section_check(spark):
    s = spark.createDataFrame([(0, "block", b"a"), (1, "metadata", b"m"), (2, "metadata", b"n"), (3, "block", b"b")], "number long, kind string, payload binary")
    s = s.withColumns({"fast": F.xxhash64("payload"), "digest": F.when(F.col("number") == 3, "0").otherwise(F.sha2("payload", 256))})
    assert {tuple(r) for r in section_errors(s, "checksum").collect()} == {("duplicate", 2)}
    assert {tuple(r) for r in section_errors(s, "full").collect()} == {("duplicate", 2), ("damaged", 3)}
    with pytest.raises(ValueError):
        section_errors(s, "none")
