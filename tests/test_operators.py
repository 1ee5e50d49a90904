import random

from cairn.operators import merging, segmenting, sequences, similarity
from cairn.scale import lagged, numbered, running


def test_global_order_helpers(spark):
    rows = [(i * 7 % 1000, i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    total, expected = 0, {}
    for k, v in sorted(rows):
        total += v
        expected[k] = total
    from pyspark.sql import functions as F

    assert {r["k"]: r["s"] for r in running(df, ["k"], {"s": F.col("v")}).collect()} == expected
    assert {r["k"]: r["n"] for r in numbered(df, ["k"], "n").collect()} == {k: k for k, _ in rows}
    by_key = dict(rows)
    assert {r["k"]: r["p"] for r in lagged(df, "v", ["k"], "p", default=-1).collect()} == {k: by_key[k - 1] if k else -1 for k in by_key}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, v long")
    from pyspark.sql import functions as F

    assert running(df, ["k"], {"s": F.col("v")}).count() == numbered(df, ["k"], "n").count() == lagged(df, "v", ["k"], "p").count() == 0


def test_unpack_golden(spark):
    packed = spark.createDataFrame(list(enumerate([0, 3, 1, 0, 1])), "ix long, packed long")
    got = sorted(r["ix"] for r in sequences.unpack_runs(packed, "ix", "packed").collect())
    assert got == [0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4]


def test_seek_golden(spark):
    from cairn.operators.reading import seek

    chunks = spark.createDataFrame([(1, 0, 0, 4, False), (1, 1, 4, 3, True), (1, 2, 7, 13, False)], "file long, ord long, offset long, size long, hole boolean")
    asked = spark.createDataFrame([(1, s) for s in (0, 2, 3, 4, 5, 6, 7, 10, 19, 20)], "file long, start long")
    got = {r["start"]: (r["data"], r["hole"]) for r in seek(chunks, asked).collect()}
    assert [got[s][1] for s in (0, 2, 3)] == [4, 4, 4] and [got[s][0] for s in (4, 5, 6)] == [7, 7, 7] and [got[s][1] for s in (7, 10, 19)] == [20, 20, 20] and 20 not in got


def test_segmenter_is_lossless_and_finds_repeats():
    rng = random.Random(5)
    base = bytes(rng.randrange(256) for _ in range(5000))
    files = [base, base[1000:4000] + b"new" * 50, b"\0" * 3000, b"", b"short", base[:2500] + base[:2500], b"\0" * 3000]
    for config in (segmenting.Config(6, 1, 12, 3), segmenting.Config(7, 2, 16, 1), segmenting.Config(0, 1, 12, 1), segmenting.Config(6, 1, 13, 2, granularity=4)):
        s = segmenting.Segmenter(config)
        for k, f in enumerate(files):
            f = f[: len(f) - len(f) % config.granularity]
            s.add(k, f)
        blocks = dict(s.finish())
        back = {}
        for key, _, block, offset, size in s.chunks:
            back[key] = back.get(key, b"") + blocks[block][offset : offset + size]
        for k, f in enumerate(files):
            assert back.get(k, b"") == f[: len(f) - len(f) % config.granularity]
        if config.window_bits:
            assert s.stats["reused"] > 2500
        assert all(len(b) <= config.capacity for b in blocks.values())


def test_merge_positions_with_limited_slots():
    assert merging.merge_positions({"a": 2, "b": 1, "c": 2}, 2) == [("a", 0), ("b", 0), ("a", 1), ("c", 0), ("c", 1)]
    assert merging.merge_positions({}, 2) == []


def test_similarity_orders_are_one_a_category(spark, tmp_path):
    from cairn.plans import kernel_queries, more_queries

    texts = {1: "the quick brown fox jumps over the lazy dog " * 9, 2: "0123456789 lorem ipsum dolor sit amet " * 5, 9000: "the quick brown fox jumps over the lazy dog " * 8}
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["position"], r["ino"]) for r in kernel_queries.p06(spark, str(tmp_path)).collect())
    assert [p for p, _ in got] == [0, 1, 2] and got[1][1] != 2
    spark.createDataFrame([(1, [1.0] * 64, 0), (2, [-1.0] * 64, 0), (9000, [1.0] * 60 + [-1.0] * 4, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r["position"], r["vec_id"]) for r in more_queries.p07(spark, str(tmp_path)).collect()) == [(0, 1), (1, 9000), (2, 2)]


def test_similarity_order_is_a_permutation():
    import numpy as np

    v = np.random.default_rng(4).integers(0, 1 << 62, (600, 4), dtype=np.uint64)
    assert sorted(similarity.order(v, np.arange(600), most_size=50, most_children=8)) == list(range(600))


def test_files_there_and_back(spark, tmp_path):
    import io
    import tarfile

    from cairn.functions.globbing import parse_rules
    from cairn.sources.files import archives, extract, read_list, read_tree

    for name, content in {"a/x.txt": b"one", "a/b/y.bin": b"\0\1", "z.txt": b"z"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    root = f"file://{tmp_path}/in"
    files = read_tree(spark, root)
    assert {r["path"]: bytes(r["content"]) for r in files.collect()} == {"/a/x.txt": b"one", "/a/b/y.bin": b"\0\1", "/z.txt": b"z"}
    assert [r["path"] for r in read_tree(spark, root, parse_rules("+ *.bin\n- *")).collect()] == ["/a/b/y.bin"]
    listed = spark.createDataFrame([("z.txt", 0), ("./a//x.txt", 1), ("z.txt", 2)], "path string, position long")
    assert {r["path"]: r["order_index"] for r in read_list(spark, root, listed).collect()} == {"/z.txt": 0, "/a/x.txt": 1}
    assert extract(files, f"{tmp_path}/out") == 3 and (tmp_path / "out/a/b/y.bin").read_bytes() == b"\0\1"
    names = [m.name for r in archives(files, 2).collect() for m in tarfile.open(fileobj=io.BytesIO(r["archive"])).getmembers()]
    assert sorted(names) == ["a/b/y.bin", "a/x.txt", "z.txt"]


def test_hamming_join_by_brute_force(spark):
    import random

    from cairn.operators import hamming

    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    rows = [x ^ sum(1 << b for b in r.sample(range(64), k)) for x in base for k in (0, 2, 3, 5, 9, 12, 13, 15)]
    signed = [x - (1 << 64) if x >> 63 else x for x in rows]
    v = spark.createDataFrame(list(enumerate(signed)), "vec_id long, bits long")
    for most in (0, 1, 2, 3, 7, 12):
        got = {(x["a"], x["b"], x["distance"]) for x in hamming.within(v, v, most).where("a < b").collect()}
        assert got == {(i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (d := (rows[i] ^ rows[j]).bit_count()) <= most}


def test_hamming_join_in_blocks_and_without_broadcast(spark):
    import random

    from cairn.operators import hamming

    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(20)]
    rows = [x ^ sum(1 << b for b in r.sample(range(64), k)) for x in base for k in (0, 5, 12, 13)]
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(rows)]
    v = spark.createDataFrame([*signed, (999, None), signed[0]], "vec_id long, bits long")  # a row twice counts twice, as in SQL
    got = sorted((x["a"], x["b"], x["distance"]) for x in hamming.within(v, v, 12, block=9).where("a < b").collect())
    both = [(k, x & (1 << 64) - 1) for k, x in [*signed, signed[0]]]
    assert got == sorted((i, j, d) for i, x in both for j, y in both if i < j and (d := (x ^ y).bit_count()) <= 12)
    for most in (3, 7, 12):  # nothing goes through the driver, however small the planner takes the vectors to be
        assert "Broadcast" not in hamming.within(v, v, most)._jdf.queryExecution().executedPlan().toString()


def test_rate_is_one_sort_and_equals_sql_on_crowded_windows(spark, tmp_path):
    from compare import connection, rows_of_spark, rows_of_sql

    from cairn import plans

    ts = "IF(id % 11 = 0, NULL, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (id * 37 % 5000) * 20))"
    kind = "IF(id % 7 = 0, NULL, concat('t', id % 3))"
    spark.range(6000).selectExpr("id AS event_id", f"{ts} AS ts", "id AS user_id", f"{kind} AS event_type", "1.0D AS value", "'' AS props").coalesce(1).write.parquet(f"{tmp_path}/in")
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = plans.QUERIES["t01_rate"](spark, str(tmp_path))
    assert "RangeFrame" not in got._jdf.queryExecution().optimizedPlan().toString()  # it takes time by rows times rows of a window
    assert rows_of_spark(got) == rows_of_sql(connection(tmp_path), plans.ORACLES["t01_rate"])


def test_exact_quantiles(spark):
    import random

    from cairn.operators.sketches import exact_quantiles

    r = random.Random(3)
    rows = [(g, r.randrange(40) if g else 7) for g in range(5) for _ in range(1 + 37 * g)] + [(1, None)]
    got = {x["g"]: (x["a"], x["b"]) for x in exact_quantiles(spark.createDataFrame(rows, "g long, v long"), "g", "v", {"a": 0.5, "b": 0.99}).collect()}
    for g in range(5):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == tuple(next(x for i, x in enumerate(v) if i + 1 >= p * len(v)) for p in (0.5, 0.99))
