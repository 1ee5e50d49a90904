"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits.  Two that differ in at most four bits, cut into three segments, differ in at
most one bit of some segment.  So every distinct fingerprint is indexed under each segment with each one
of its bits left out; equality of such a variant finds all pairs that may link, and the bits decide.
With very many fingerprints, more and combined segments keep the index keys selective (``plan_for``);
every plan finds the same links.

Cases: null and wordless texts have fingerprint zero and link like others; very long texts count whole, in runs of
shingles; exact copies share one fingerprint and meet only in a grouped row; a component whose doc_ids are all null has a
null id; repeated rows stay in ``near_duplicates``, which ignores extra columns; ``one_of_each`` tells rows apart by an id
of their own, and of equal doc_ids (ties) keeps the first row; an empty table has no groups; doc_id may have any type;
extra columns pass through ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import fresh, numbered, per_batch, small_or_shuffled, spill, text_bytes
from .text import repeated

MOST_BITS = 4
_CHUNK = 1 << 18
#: Fingerprints up to which a plan (segments, how many of the best together) is used.
PLANS = [(1 << 23, (3, 1)), (1 << 28, (5, 2)), (1 << 62, (6, 3))]


def fingerprint(text: bytes, size: int = 4) -> int:
    """The bits set in over half of the XXH64 (seed 42) of all word shingles, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[low:high], ends[low + size - 1 :] or ends[-1:], strict=False)), np.uint64, high - low)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, and ``_fp`` (the fingerprint as a signed long)."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], names=[*rest, "_fp"])

    schema = docs.select(*rest).schema.add("_fp", "long")
    return docs.select(text_bytes().alias("text"), *rest).mapInArrow(per_batch(run), schema)


def plan_for(rows: int) -> tuple[int, int]:
    return next(plan for most, plan in PLANS if rows <= most)


def masks(segments: int, best: int) -> list[tuple[int, int]]:
    """(group, mask) of every index variant: ``best`` of the segments together, one bit of them left out."""
    # e errors over s segments: the b best hold at most floor(e * b / s) in all, and for the plans here that is one
    edges = np.linspace(0, 64, segments + 1).astype(int)
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for chosen in combinations(parts, best):
        whole = sum(chosen)
        out += [(len(out) + k, whole & ~(1 << bit)) for k, bit in enumerate(b for b in range(64) if whole >> b & 1)]
    return out


def _near(a: np.ndarray, b) -> np.ndarray:
    # unsigned: the count of a negative number is that of its absolute value
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected in one bucket; each found member leaves the search, so copies of one text cost little."""
    left, found = members, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            f = frontier.pop()
            hit = _near(left, f)
            if hit.any():
                found += [(f, x) for x in left[hit]]
                frontier += list(left[hit])
                left = left[~hit]
    return found


def bucket_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys: every pair of small runs is tested, larger ones are searched."""
    keys, values = repeated(keys, values)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= 16, sizes)
    a, b = [], []
    for step in range(1, 16):
        if step >= len(keys) or not (sizes[sizes <= 16] > step).any():
            break
        pair = small[:-step] & (keys[step:] == keys[:-step])
        pair[pair] = _near(values[:-step][pair], values[step:][pair])
        a.append(values[:-step][pair])
        b.append(values[step:][pair])
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        if links := _forest(values[s : s + n]):
            x, y = np.array(links, values.dtype).T
            a.append(x)
            b.append(y)
    none = np.zeros(0, values.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``_fp``) that connect all that differ in at most four bits."""
    variants = masks(*plan_for(fps.count() if rows is None else rows))
    groups = np.array([g for g, _ in variants], np.int64)
    bits = np.array([m for _, m in variants], np.uint64)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048].view(np.uint64)
                # the masked bits and the variant's number, mixed one to one enough that equal keys are equal variants
                keys = (part[:, None] & bits[None, :]) * np.uint64(0x9E3779B97F4A7C15) + groups.astype(np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.view(np.int64), len(bits)))], names=["k", "f"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            a, b = bucket_links(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    index = fps.select("_fp").mapInArrow(indexed, "k long, f long")
    return index.repartition(F.col("k")).mapInArrow(linked, "a long, b long").distinct()


def rooted(prints: DataFrame, first) -> DataFrame:
    """_fp, its component's ``root``, and the smallest ``first`` of its rows, for every distinct fingerprint of ``prints``."""
    distinct = spill(prints.groupBy("_fp").agg(F.min(first).alias("first")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "_fp")
    return spill(distinct.join(roots, "_fp", "left").select("_fp", "first", F.coalesce("root", "_fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, _fp and component_id (the smallest doc_id reachable over links) of every row of ``docs``."""
    prints = spill(fingerprints(docs.select("doc_id", "text")), "prints")
    found = rooted(prints, F.col("doc_id"))
    ids = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(ids, "root").select("_fp", "component_id")
    return prints.join(named, "_fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with only the first row of each component: its smallest doc_id, null ids last, and of equal ones the first row.

    Rows are told apart by an id of their own, not by doc_id.  Only fingerprints and ids are grouped; the documents are
    read again and joined with the ids that go.
    """
    names = docs.columns
    row = fresh(names, "row")
    docs = numbered(docs, "docs", row)
    prints = spill(fingerprints(docs.select("doc_id", "text", F.col(row).alias("row"))), "prints")
    found = rooted(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    kept = found.groupBy("root").agg(F.min("first")["row"].alias("kept"))
    named = found.join(kept, "root").select("_fp", "kept")
    gone = spill(prints.join(named, "_fp").where("row <> kept").select(F.col("row").alias(row)), "gone")
    return docs.join(small_or_shuffled(gone), row, "left_anti").select(*names)
