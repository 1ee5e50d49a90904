"""Fuzzy line deduplication by MinHash.

Equal lines are one node (a 128-bit digest).  Each distinct line gets a MinHash signature over its
character shingles; bands of the signature are index keys; lines that share a key are compared by the
exact Jaccard similarity of their shingle sets; links are joined into components by distributed
union-find, and of each component the first line (by doc_id, then line number) stays.

What a bucket holds is compared by search, not pair by pair: a line that is found linked leaves the
search, so a bucket of copies costs about its size.  Buckets above ``MOST_TOGETHER`` lines are cut into
blocks and every pair of blocks is compared in a task of its own, so no task holds an unbounded group.

Cases: lines without a word are never removed; null and empty texts have no lines and stay; very long texts
are indexed in slices, and a very long line is one line like any other; an empty table has no repeated lines;
null doc_ids come last when the first line is chosen; lines are removed by row, so rows that share a doc_id,
or have none, are each a document; of equal doc_id and line number (ties) the first row stays; doc_id may
have any type; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import forget, fresh, numbered, per_batch, slices, small_or_shuffled, spill, text_bytes
from .text import mixed, repeated

SHINGLE, SIMILAR = 5, 0.8
#: Short shingles are shared by chance, so a band has many rows: lines alike by chance seldom meet, and the index and
#: the candidates stay small.  A band takes ``ROWS`` of the ``VALUES`` MinHash values; each value serves one or two bands.
#: P(no common band), by simulation, is 0.2 % at a similarity of 0.8, and under 0.01 % at 0.85.
VALUES, BANDS, ROWS = 84, 24, 6
MOST_TOGETHER = 1_000
#: Index entries (a band key and a line) of a shuffled block, and of a task's table.
_BLOCK, _TASK = 1 << 20, 1 << 22
#: Top bits of a short digest, at most, in the map by which a task tells lines of no bucket.
_MAP = 28
_SCALE = np.random.default_rng(6).integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = np.random.default_rng(66).integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_FOLD = np.random.default_rng(666).integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def _chosen() -> np.ndarray:
    """The values of each band: successive shuffles of all values, so that they serve about equally often."""
    rng = np.random.default_rng(6666)
    return np.concatenate([rng.permutation(VALUES) for _ in range(-(-BANDS * ROWS // VALUES))])[: BANDS * ROWS].reshape(BANDS, ROWS)


_CHOSEN = _chosen()


def digest(line: bytes) -> bytes:
    return blake2b(line, digest_size=16).digest()


def shingle_hashes(lines: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles (runs of ``size`` code points) of all lines, and where each line's start.

    A shorter line is one shingle.
    """
    padded = [t if len(t) >= size else t.ljust(size, "\0") for t in (ln.decode("utf-8", "replace") for ln in lines)]
    raw = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in padded], np.int64)
    whole = raw[: len(raw) - size + 1].copy()
    for k in range(1, size):
        whole *= np.uint64(0x9E3779B97F4A7C15)
        whole += raw[k : len(whole) + k]
    counts = lengths - size + 1
    starts = np.cumsum(counts) - counts
    inside = np.ones(len(raw), bool)
    ends = np.cumsum(lengths)
    for k in range(1, size):
        inside[ends - k] = False
    return mixed(whole[inside[: len(whole)]]), starts


def signatures(lines: list[bytes]) -> np.ndarray:
    """MinHash values of each line, ``VALUES`` columns."""
    out = np.empty((len(lines), VALUES), np.uint32)
    for a, b in slices(lines, 1 << 15):  # the hashes of a slice stay in a core's own cache
        hashes, starts = shingle_hashes(lines[a:b])
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        turned = np.empty_like(h)
        for k in range(VALUES):
            np.bitwise_xor(h, _SHIFT[k], out=turned)
            np.multiply(turned, _SCALE[k], out=turned)
            out[a:b, k] = np.minimum.reduceat(turned, starts)
    return out


def band_keys(lines: list[bytes]) -> np.ndarray:
    """One 64-bit key for each line and band."""
    values = signatures(lines)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), 1))
    for row in range(ROWS):
        key = mixed(key * _FOLD[row] + values[:, _CHOSEN[:, row]])
    return key.view(np.int64)


def _worded(text: bytes) -> list[tuple[int, bytes]]:
    return [(k, ln) for k, ln in enumerate(text.split(b"\n")) if ln.strip()]


def short(h: bytes) -> int:
    """The part of a digest that the index carries.  Two lines that share it only meet in a verification."""
    return int.from_bytes(h[:8], "little", signed=True)


def occurrences(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A row for each line with a word: digest ``h``, doc_id, line number ``n`` and the ``row`` it stands in (as the column ``row`` says, if given)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(at, digest(ln), k) for at, t in enumerate(batch.column(1).to_pylist()) for k, ln in _worded(t)]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), batch.column(0).take(at), pa.array([r[2] for r in rows], pa.int64()), batch.column(2).take(at)], names=["h", "doc_id", "n", "row"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("text"), number.alias("row")).mapInArrow(per_batch(run), f"h binary, doc_id {kind}, n long, row long")


def buckets(docs: DataFrame, lines: int) -> DataFrame:
    """(deal, bucket, part, s): the short digests of every band key that several of the ``lines`` distinct lines share.

    A task indexes a line once.  Index entries travel in blocks, one for each part of the key space, and the parts
    grow with the number of lines, so a task's table has about ``_TASK`` entries.  The same set of lines under
    several keys is one bucket; a large bucket is repeated for pairs of its blocks.  ``deal`` is the least member of a
    small bucket: buckets that have it in common hold much the same lines, and a task that has them all reads each once.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines * BANDS // _TASK))
    parts = 4 * tasks

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 1 << 21):
                if len(met) > 200_000:
                    met.clear()
                new = {}
                for line in {ln for t in texts[a:b] for _, ln in _worded(t)}:
                    if (s := short(digest(line))) not in met:
                        new[line] = s
                met.update(new.values())
                if new:
                    held.append((band_keys(list(new)).ravel(), np.repeat(np.fromiter(new.values(), np.int64, len(new)), BANDS)))
                if sum(len(k) for k, _ in held) > _BLOCK:
                    yield dealt(held)
                    held = []
        if held:
            yield dealt(held)

    def dealt(held) -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
        part = part.astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, both = part[order], np.stack([keys[order], ids[order]], axis=1)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        offsets = pa.py_buffer(np.append(starts, len(part)).astype(np.int64) * 16)
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(both)]).cast(pa.binary())], names=["p", "entries"])

    def shared(entries: list[bytes]):
        keys, ids = np.frombuffer(b"".join(entries), np.int64).reshape(-1, 2).T
        keys, ids = repeated(keys, ids)
        if not len(keys):
            return
        new = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        keys, ids = keys[new], ids[new]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        for at, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            members = ids[at : at + n]
            yield int.from_bytes(blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True), members

    def emitted(batches):
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.setdefault(p, []).append(entries)
        out, size = [], 0
        while got:
            for name, members in shared(got.popitem()[1]):
                blocks = [members[i : i + MOST_TOGETHER] for i in range(0, len(members), MOST_TOGETHER)]
                pairs = ((i, j) for i in range(len(blocks)) for j in range(i, len(blocks)) if j > i or len(blocks) == 1)
                for part, (i, j) in enumerate(pairs):
                    out.append((members[0] if len(members) <= 64 else name, name, part, blocks[i] if i == j else np.concatenate([blocks[i], blocks[j]])))
                    size += len(out[-1][3])
                    if size > 50_000:
                        yield rows(out)
                        out, size = [], 0
        if out:
            yield rows(out)

    def rows(out):
        sizes = [len(r[3]) for r in out]
        named = [pa.array(np.repeat([r[k] for r in out], sizes)) for k in range(3)]
        return pa.RecordBatch.from_arrays([*named, pa.array(np.concatenate([r[3] for r in out]))], names=["deal", "bucket", "part", "s"])

    index = docs.select(text_bytes().alias("text")).mapInArrow(indexed, "p int, entries binary")
    return index.repartition(tasks, F.col("p")).mapInArrow(emitted, "deal long, bucket long, part long, s long").distinct()


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    out: list[np.ndarray] = []
    for a, b in slices(lines):
        hashes, starts = shingle_hashes(lines[a:b])
        for s in np.split(hashes, starts[1:]):
            s.sort()
            out.append(s[np.append(True, s[1:] != s[:-1])])
    return out


def similar_pairs(lines: list[bytes], least: float = SIMILAR, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of line numbers that connect all lines whose shingle sets have a Jaccard similarity of ``least``.

    Each line that the search reaches is compared with all that are left and near enough in size, exactly, in one pass
    over their shingles: looked up in the line's sorted set, or, among many lines, by numbers given to the shingles once.
    """
    sets = shingle_sets(lines) if sets is None else sets
    sizes = np.array([len(s) for s in sets])
    left, found = np.argsort(sizes, kind="stable"), []
    many = len(lines) > 64
    if many:
        flat = np.unique(np.concatenate([sets[k] for k in left]), return_inverse=True)[1]
        mark = np.zeros(flat.max(initial=0) + 1, bool)
        ends = np.cumsum(sizes[left])
        spans = {k: flat[e - sizes[k] : e] for k, e in zip(left.tolist(), ends.tolist(), strict=True)}
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            f = frontier.pop()
            low, high = np.searchsorted(sizes[left], [least * sizes[f] - 1e-9, sizes[f] / least + 1e-9])
            near = left[low:high]
            if not len(near):
                continue
            if many:
                mark[spans[int(f)]] = True
                same = mark[np.concatenate([spans[int(k)] for k in near])]
                mark[spans[int(f)]] = False
            else:
                own, others = sets[f], np.concatenate([sets[k] for k in near])
                same = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            common = np.add.reduceat(same, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            hit = np.zeros(len(left), bool)
            hit[low:high] = common >= least * (sizes[f] + sizes[near] - common) - 1e-9
            found += [(int(f), int(x)) for x in left[hit]]
            frontier += list(left[hit])
            left = left[~hit]
    return found


def key_map(keys: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """How many top bits of a key count, and a map of them in bytes of eight: the bit of every key ``s`` of ``keys`` is on.

    The map grows with the ``rows`` up to 2 ** ``_MAP`` bits (32 MB); beyond that more keys that are not there have their bit on.
    """
    bits = min(_MAP, max(16, (8 * rows).bit_length()))
    width = 1 << max(bits - 12, 3)  # bits of a block, which one task sets whole

    def marked(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for block in np.unique(bit // width).tolist():
                out.setdefault(block, np.zeros(width, bool))[bit[bit // width == block] % width] = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in out.values()], pa.binary())], names=["block", "bits"])

    found = keys.select("s").repartition(F.shiftrightunsigned("s", 64 - bits + width.bit_length() - 1)).mapInArrow(marked, "block int, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for block, raw in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
        out[block * width // 8 : (block + 1) * width // 8] = np.frombuffer(raw.as_buffer(), np.uint8)
    return bits, out


def in_map(s: np.ndarray, bits: int, found: np.ndarray) -> np.ndarray:
    """Which keys ``s`` have their bit on in a map of ``key_map``."""
    bit = np.ascontiguousarray(s).view(np.uint64) >> np.uint64(64 - bits)
    return (found[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def similar_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b) of digests of similar lines, verified on the lines of ``docs``."""
    size = members.count()
    bits, found = key_map(members, size)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {digest(ln): ln for t in batch.column(0).to_pylist() for _, ln in _worded(t)}
        s = np.frombuffer(b"".join(found), np.int64)[::2]
        at, own = np.flatnonzero(in_map(s, bits, shared.value)), list(found.items())
        return pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array([own[k][0] for k in at], pa.binary()), pa.array([own[k][1] for k in at], pa.binary())], names=["s", "h", "line"])

    # lines that no bucket holds stay where they are, all but the few whose bit is on by chance; the join by key drops these
    texts = docs.select(text_bytes().alias("text")).mapInArrow(per_batch(lines), "s long, h binary, line binary")
    texts = texts.groupBy("s", "h").agg(F.min("line").alias("line"))

    def verified(batches):
        got: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, part, h, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.setdefault((bucket, part), []).append((h, line))
        lines = {h: line for rows in got.values() for h, line in rows}
        sets = dict(zip(lines, shingle_sets(list(lines.values())), strict=True))  # each line once, whatever its buckets
        found: set[tuple[bytes, bytes]] = set()
        for rows in got.values():
            rows.sort()
            found.update((rows[i][0], rows[j][0]) for i, j in similar_pairs([line for _, line in rows], sets=[sets[h] for h, _ in rows]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    joined = members.join(texts, "s").select("bucket", "part", "h", "line", "deal")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 20_000)
    return joined.repartition(tasks, "deal", "part").drop("deal").mapInArrow(verified, "a binary, b binary")


def line_components(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences: h, doc_id, n, row) and (lines: h, root, copies, first as a struct of no_id, doc_id, n and row)."""
    seen = spill(occurrences(docs, row), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n", "row")
    nodes = spill(seen.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "nodes")
    members = spill(buckets(docs, nodes.count()), "buckets")
    roots = components(similar_links(docs, members))
    forget(members)
    rooted = nodes.join(roots, nodes["h"] == roots["node"], "left").select("h", F.coalesce("root", "h").alias("root"), "first", "copies")
    return seen, spill(rooted, "rooted")


def repeated_lines(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Every line that is not alone in its component: doc_id, line ``n``, the component's first line (kept_doc, kept_line), ``kept``, ``row``."""
    seen, rooted = line_components(docs, row)
    groups = rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("copies").alias("copies")).where("copies > 1")
    repeated = spill(rooted.select("h", "root").join(groups, "root").select("h", F.col("keeper.doc_id").alias("kept_doc"), F.col("keeper.n").alias("kept_line"), F.col("keeper.row").alias("kept_row"), "copies"), "repeated")
    kept = (F.col("row") == F.col("kept_row")) & (F.col("n") == F.col("kept_line"))
    return seen.join(small_or_shuffled(repeated, 300_000), "h").select("doc_id", "n", "kept_doc", "kept_line", "copies", kept.alias("kept"), "row")


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without repeated lines; documents that lose every line with a word go, if ``drop_emptied``."""
    names, schema = docs.columns, docs.schema
    row, lost = fresh(names, "row"), fresh(names, "lost")
    docs = numbered(docs, "docs", row)
    found = repeated_lines(docs.select("doc_id", "text", row), row)
    gone = spill(found.where("NOT kept").groupBy("row").agg(F.collect_set("n").alias("lost")), "gone")
    gone = small_or_shuffled(gone.toDF(row, lost), 200_000)
    joined = docs.join(gone, row, "left").select(*names, lost)
    text = names.index("text")

    def run(batches):
        for batch in batches:
            texts, gone = batch.column(text).cast(pa.string()).to_pylist(), batch.column(len(names)).to_pylist()
            keep, out = [], []
            for k, (t, g) in enumerate(zip(texts, gone, strict=True)):
                if g:
                    g = set(g)
                    lines = [ln for n, ln in enumerate(t.split("\n")) if n not in g]
                    if drop_emptied and not any(ln.encode().strip() for ln in lines):
                        continue
                    t = "\n".join(lines)
                keep.append(k)
                out.append(t)
            rows = batch.take(pa.array(keep, pa.int64()))
            arrays = list(rows.columns[: len(names)])
            arrays[text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = joined.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(schema["n_chars"].dataType))
    return out
