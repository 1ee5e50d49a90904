import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import codecs, formats, globbing, kernels, modes, units
from cairn.functions.texts import cut_to_width, fold_char, shortened, width_of


def test_nilsimsa_golden():
    assert kernels.nilsimsa_hex(b"") == "0" * 64
    assert kernels.nilsimsa_hex(b"abcdefgh") == "14c8118000000000030800000004042004189020001308014088003280000078"


def test_rolling_hash_is_that_of_each_window():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    got = kernels.rolling_hashes(data, 17)
    for i in range(len(data) - 16):
        a = b = 0
        for c in data[i : i + 17]:
            a = (a + c) & 0xFFFF
            b = (b + a) & 0xFFFF
        assert got[i] == a | b << 16
    assert kernels.rolling_hashes(bytes([9] * 20), 20)[0] == kernels.constant_hash(9, 20)
    assert len(kernels.rolling_hashes(b"short", 17)) == 0


def test_bloom_filter():
    a, b = kernels.BloomFilter(1 << 12), kernels.BloomFilter(1 << 12)
    a.add(np.arange(0, 100))
    b.add(np.arange(100, 200))
    assert a.test(np.arange(0, 100)).all() and not a.test(np.arange(1000, 1100)).all()
    a.merge(b)
    assert a.test(np.arange(0, 200)).all()


def test_similarity_of_short_and_tied_contents():
    assert kernels.similarity_of(b"") == kernels.similarity_of(b"abc") == 0x00010203
    assert kernels.similarity_of(b"aaaaaaaa") >> 24 == int(np.argmax(kernels.word_buckets(b"aaaa")))


@pytest.mark.parametrize(
    ("size", "text"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1 KiB"), (1536, "1.5 KiB"), (100_000, "97.66 KiB"), (256 << 10, "256 KiB"), ((1 << 20) - 1, "1024 KiB"), (1 << 20, "1 MiB"), ((1 << 30) - 1, "1024 MiB"), (1 << 40, "1 TiB"), (1 << 50, "1 PiB")],
)
def test_size_with_unit(spark, size, text):
    assert spark.range(1).select(units.size_with_unit(F.lit(size).cast("long"))).first()[0] == text


@pytest.mark.parametrize(
    ("num", "den", "precision", "text"),
    [(1, 0, 3, "N/A"), (0, 1, 3, "0x"), (1, 1, 3, "1x"), (3, 2, 3, "1.5x"), (10744, 1000, 3, "10.7x"), (10744, 1000, 2, "11x"), (10744, 1000, 4, "10.74x"), (999, 1000, 3, "99.9%"), (1, 1000, 3, "0.1%"), (999, 10**6, 3, "999ppm"), (1, 10**6, 3, "1ppm"), (3, 2 * 10**6, 3, "1.5ppm"), (10744, 10**9, 3, "10.7ppm"), (999, 10**9, 3, "999ppb"), (1, 10**9, 3, "1ppb"), (17777, 10**16, 3, "1.78e-12x")],
)
def test_ratio(num, den, precision, text):
    assert units.ratio_text(num, den, precision) == text


def test_parsers(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    for text, value in {"3k": 3 << 10, "4m": 4 << 20, "5g": 5 << 30, "6t": 6 << 40, "1001K": 1001 << 10, "2": 2, "7y": None, "7tb": None, "asd": None}.items():
        assert one(units.parse_size(F.lit(text))) == value
    for text, value in {"3d": 3 * 86400 * 10**9, "day": 86400 * 10**9, "3ms": 3 * 10**6, "5": 5 * 10**9, "6m": 360 * 10**9, "1 ms": 10**6, "500nsec": 500, "8y": None, "8su": None, "8mss": None, "8um": None}.items():
        assert one(units.parse_time(F.lit(text))) == value
    assert one(units.parse_time_point(F.lit("InVaLiD"))) is None and one(units.parse_time_point(F.lit("2020-01-01 01:02x"))) is None
    assert str(one(units.parse_time_point(F.lit("20200102T030405")))) == "2020-01-02 03:04:05"
    assert [one(units.to_bool(F.lit(t))) for t in ("Yes", "f", "oN", "maybe")] == [True, False, True, None]


@pytest.mark.parametrize(
    ("ns", "text"), [(0, "0s"), (999, "999ns"), (1500, "1.5us"), (1_234_567, "1.234ms"), (59_999_999_999, "59.99s"), (60 * 10**9, "1m"), (3661 * 10**9, "1h 1m 1s"), (90061 * 10**9, "1d 1h 1m"), (61_500_000_000, "1m 1.5s")]
)
def test_time_with_unit(spark, ns, text):
    assert spark.range(1).select(units.time_with_unit(F.lit(ns).cast("long"))).first()[0] == text


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.cpp", ["a.cpp", ".cpp"], ["a/b.cpp", "a.cp"]), ("{README,NOTES}.md", ["README.md", "NOTES.md"], ["X.md"]), ("file{1,{2,3}}.txt", ["file1.txt", "file3.txt"], ["file4.txt"]),
        ("data?.csv", ["data1.csv"], ["data.csv", "data/.csv"]), ("log[!0-9].txt", ["loga.txt"], ["log1.txt"]), ("src/**/main.cpp", ["src/a/b/main.cpp", "src/xmain.cpp"], ["main.cpp"]), ("**/test.cpp", ["a/test.cpp", "test.cpp"], ["test.c"]), ("src/**", ["src/a/b"], ["lib/a"]), ("a/*/b", ["a/x/b"], ["a//b"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = {r[0] for r in df.where(globbing.matches_any(F.col("p"), [glob])).collect()}
    assert got == set(yes)


@pytest.mark.parametrize("glob", ["a\\", "a{b", "a}b", "a]b", "a[b", "a[/]", "[z-a]"])
def test_glob_errors(glob):
    with pytest.raises(globbing.GlobError):
        globbing.regex_of(glob)


def test_rules_first_match_merge_and_recursion(spark):
    rules = globbing.parse_rules("+ *.so\n- *\n")
    df = spark.createDataFrame([("/a/b.so",), ("/a/b.txt",)], "p string")
    assert [r[0] for r in df.select(globbing.kept_by(F.col("p"), rules)).collect()] == [True, False]
    with pytest.raises(globbing.GlobError):
        globbing.parse_rules(". x", {"x": ". x"}.__getitem__)
    with pytest.raises(globbing.GlobError):
        globbing.parse_rules("* nothing")


@pytest.mark.parametrize(
    ("spec", "mode", "is_dir", "expected"),
    [("u+x", 0o644, False, 0o744), ("u+x", 0o755, True, 0o755), ("0644", 0o777, False, 0o644), ("a=rX", 0o644, False, 0o444), ("a=rX", 0o644, True, 0o555), ("g=u", 0o741, False, 0o771), ("o-rwx", 0o777, False, 0o770), ("D+x", 0o644, False, 0o644), ("D+x", 0o644, True, 0o755), ("+w", 0o444, False, 0o644), ("u+s,g+s", 0o755, False, 0o6755), ("a-t", 0o1777, False, 0o777), ("u=rw,go=r", 0o777, False, 0o644)],
)
def test_chmod(spark, spec, mode, is_dir, expected):
    assert spark.range(1).select(modes.chmod(F.lit(mode), F.lit(is_dir), spec)).first()[0] == expected


@pytest.mark.parametrize("spec", ["", "x", "8", "u", "u+", "u+q", "77777", "u+7"])
def test_chmod_errors(spec):
    with pytest.raises(modes.ChmodError):
        modes.parse_chmod(spec)


@pytest.mark.parametrize("name", ["null", "lz4", "lz4hc:level=9", "zstd:level=5", "lzma:level=1", "brotli:quality=5", "ricepp", "ricepp:components=2"])
def test_codec_roundtrip(name):
    pack, unpack = codecs.functions(codecs.parse(name))
    walk = np.cumsum(np.random.default_rng(1).integers(-9, 9, 999)).astype("<i2").tobytes()
    for data in (b"", b"x", b"abc" * 100, walk, bytes(range(256)) * 3 + b"!"):
        assert unpack(pack(data)) == data
    if name.startswith("ricepp"):
        assert len(pack(walk)) < len(walk)


@pytest.mark.parametrize("spec", ["what", "zstd:level=1:level=2", "zstd:speed=1"])
def test_codec_spec_errors(spec):
    with pytest.raises(codecs.CodecError):
        codecs.parse(spec)


def test_samples_roundtrip():
    v = np.random.default_rng(2).integers(-(1 << 19), 1 << 19, 100)
    for big in (False, True):
        for signed in (False, True):
            for low in (False, True):
                args = (20, 3, big, signed, low)
                assert (codecs.unpack_samples(codecs.pack_samples(v, *args), *args) == v).all()


def test_incompressible_fragments():
    rng = np.random.default_rng(3)
    text = (b"some quite ordinary text " * 600)[: 12 << 10]
    noise = [rng.integers(0, 256, 12 << 10, dtype=np.uint8).tobytes() for _ in range(2)]
    got = formats.incompressible(text + noise[0] + text + noise[1] + text[: 3 << 10], block=8192)
    assert [(c, n) for c, _, n in got] == [("default", 16384), ("incompressible", 8192), ("default", 16384), ("incompressible", 8192), ("default", 3072)]
    assert formats.incompressible(text) == [] and formats.incompressible(b"x") == []


def test_formats():
    wav = b"RIFF" + struct.pack("<I", 60) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 402) + b"\1" * 402
    got = formats.categorize(wav, ["pcmaudio", "incompressible"])
    assert [(c, n) for c, _, n in got] == [("metadata", 44), ("waveform", 400), ("default", 2)]
    cards = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in (("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 4), ("NAXIS2", 3))) + "END".ljust(80)
    fits = cards.ljust(2880).encode() + struct.pack(">12H", *[4 * k for k in range(12)])
    assert formats.categorize(fits, ["fits"])[1] == ("image", "1 components, 2 unused bits", 24)
    elf = b"\x7fELF\x02\x01" + b"\0" * 12 + struct.pack("<H", 62) + b"\0" * 44
    assert formats.categorize(elf, ["binary"]) == [("binary/elf", "x86_64 little", 64)] or formats.categorize(elf, ["binary"])[0][0] == "binary/elf"
    assert formats.categorize(b"plain", ["pcmaudio", "fits", "binary"]) == [("default", None, 5)] and formats.categorize(b"", ["fits"]) == []


def test_container_behind_header_and_broken():
    raw = b"junk" + formats.MAGIC + b"more" + formats.section(0, 1, b"hello") + formats.section(1, 2, b"")
    assert formats.read_sections(raw) == [(0, 1, b"hello"), (1, 2, b"")]
    assert formats.find_container(raw[:-1] + b"\xff") in (-1, raw.index(formats.section(0, 1, b"hello")))
    assert formats.find_container(b"nothing") == -1


def test_texts():
    assert width_of("a日é") == 4 and cut_to_width("日本語", 5) == "日本"
    assert fold_char("ẞ") == "ß" and fold_char("ß") == "ß" and fold_char("A") == "a"


@pytest.mark.parametrize(
    ("path", "most", "expected"),
    [
        ("/short", 24, "/short"), ("/a/very/long/path/with/many/components.txt", 24, ".../many/components.txt"), ("/a/very/long/path/with/many/components.txt", 18, ".../components.txt"),
        ("/a/very/long/path/with/many/components.txt", 14, ".../compone..."), ("/foo/bar/baz", 8, ".../baz"), ("/foo/bar/baz", 7, ".../baz"), ("/foo/bar/bazaar", 7, ".../..."), ("/foo/bar/bazaar", 6, "..."), ("/foo/bar", 2, ""), ("name-without-parts", 10, "...name..."),
    ],
)
def test_shortened(path, most, expected):
    assert shortened(path, most) == expected and len(expected) <= max(most, 0)


def test_codec_levels_and_windows():
    text = b"".join(b"%d-%d;" % (k * k % 977, k % 31) for k in range(20_000))
    size = {spec: len(codecs.functions(codecs.parse(spec))[0](text)) for spec in ("lz4", "lz4hc:level=9", "zstd:level=3", "zstd:level=3:long")}
    assert size["lz4hc:level=9"] < size["lz4"]
    block = np.random.default_rng(4).integers(0, 256, 1 << 20, dtype=np.uint8).tobytes()
    far = block + bytes(9 << 20) + block  # the repeat lies beyond the window of the level
    packed = {spec: codecs.functions(codecs.parse(spec)) for spec in ("zstd:level=1", "zstd:level=1:long")}
    near, long = (len(pack(far)) for pack, _ in packed.values())
    assert long < 0.6 * near and packed["zstd:level=1:long"][1](packed["zstd:level=1:long"][0](far)) == far
    with pytest.raises(codecs.CodecError):
        codecs.parse("ricepp:bits=12")


def test_incompressible_as_a_whole():
    noise = np.random.default_rng(3).integers(0, 256, 8192, dtype=np.uint8).tobytes()
    assert formats.incompressible(noise, whole=True) == [("incompressible", None, 8192)]
    assert formats.incompressible(noise + b"a" * 8192, block=8192, whole=True) == [] and formats.incompressible(noise + b"a" * 8192, block=8192) != []


def calls_of(fn):
    """What a function gives, and how many Python functions ran for it."""
    import sys

    ran = 0

    def count(frame, event, arg):
        nonlocal ran
        ran += event == "call"

    sys.setprofile(count)
    try:
        out = fn()
    finally:
        sys.setprofile(None)
    return out, ran


def test_rice_runs_by_block_and_not_by_sample():
    import numpy as np

    from cairn.functions import rice

    rng = np.random.default_rng(9)
    noise = rng.integers(0, 256, 4001, dtype=np.uint8).tobytes()
    steps = np.cumsum(rng.integers(-40, 41, 20000)).astype("<u2").tobytes()
    assert hashlib.sha256(rice.encode(noise + steps)).hexdigest()[:16] == "254a4d02735beab8"
    assert hashlib.sha256(rice.encode(steps + noise, 7, 3)).hexdigest()[:16] == "8d7155e1950ff732"
    payload, ran = calls_of(lambda: rice.encode(steps))
    assert ran < 500  # 157 blocks of 128 samples; 16 calls of numpy and more for each block before
    back, ran = calls_of(lambda: rice.decode(payload))
    assert back == steps and ran < 8000  # one call a sample before
    for data in (b"", b"a", b"ab", noise[:255], noise[:257]):
        for block, components in ((128, 1), (1, 1), (16, 2)):
            assert rice.decode(rice.encode(data, block, components)) == data


def test_segmenter_hashes_a_content_once_and_not_by_step(monkeypatch):
    import numpy as np

    from cairn.operators import segmenting

    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 50_000, dtype=np.uint8).tobytes()
    hashed = 0

    def counted(data, window):
        nonlocal hashed
        hashed += 1
        return kernels.rolling_hashes(data, window)

    monkeypatch.setattr(segmenting, "rolling_hashes", counted)
    s = segmenting.Segmenter(segmenting.Config(7, 1, 16, 4))
    for k, content in enumerate((text, text[:20_000], text[30_000:] + text[:1000])):
        s.add(k, content)
    assert hashed < 40  # once a content, and where a block or a match begins; 393 before
    assert s.stats["good"] == 3 and s.stats["reused"] > 40_000
    digest = hashlib.sha256(repr((s.chunks, s.finish(), s.stats)).encode()).hexdigest()[:16]
    assert digest == "17b386bdc5c3df2d"


def test_python_gets_few_texts_at_once(spark, sf):
    from cairn import plans

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        for name in ("s05_find_container", "v08_display_width", "v16_case_fold", "h09_constant_windows"):
            plans.QUERIES[name](spark, sf)
            assert int(spark.conf.get(key)) <= 1_000
    finally:
        spark.conf.set(key, before)


def test_clusters_count_bits_of_a_vector_once(monkeypatch):
    import numpy as np

    from cairn.operators import similarity

    v = np.unique(np.random.default_rng(8).integers(0, 1 << 62, (2000, 4), dtype=np.uint64) & np.uint64(0xFF00FF00FF), axis=0)
    unpacked, unpack = 0, np.unpackbits

    def counted(a, *args, **options):
        nonlocal unpacked
        unpacked += a.size
        return unpack(a, *args, **options)

    monkeypatch.setattr(similarity.np, "unpackbits", counted)
    got = similarity._clusters(v, 128, 64)
    assert unpacked == 32 * len(v)  # all members again for every 64th one before
    assert hashlib.sha256(repr(got).encode()).hexdigest()[:16] == "c24030f18f5aa7e8"
    assert hashlib.sha256(repr([int(x) for x in similarity.order(v, np.arange(len(v)))]).encode()).hexdigest()[:16] == "3d1412f4a3f186de"
