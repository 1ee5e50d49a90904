"""Benchmark decontamination: windows of test items looked up in every training text.

An item's windows are its runs of 13 normalised words (a shorter item is one window).  The hash set of a
block of items, whose number of windows is bounded, is broadcast; word numbers and rolling hashes find
candidates in the token stream, and the words themselves confirm them.  A benchmark of more windows is
scanned block by block with the same result.

Cases: null and wordless texts have no words and no hits; very long texts are scanned in one piece, other texts in
slices; items with null ids are left out; repeated items count once, and items of equal text are each named; an empty
benchmark hits nothing; repeated documents are each scanned; ids may have any type; extra columns pass through, and
where one has the name of a result column, the result's name gets an underscore more before it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import fresh, per_batch, slices, spill
from .text import plain_words

WINDOW = 13
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WindowIndex:
    """The windows of some items by their length: rolling hashes to find them, words to verify them."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            words = plain_words(text)
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
            if words:
                size = min(window, len(words))
                for i in range(len(words) - size + 1):
                    self.items[tuple(words[i : i + size])].add(item)
        self.values = np.append(np.zeros(1, np.uint64), np.random.default_rng(13).integers(1, 1 << 63, len(self.numbers), dtype=np.uint64))
        by_size = defaultdict(list)
        for words in self.items:
            ids = np.array([self.numbers[w] for w in words])
            by_size[len(words)].append((self.values[ids] * _powers(_INVERSE, len(ids))).sum(dtype=np.uint64))
        self.hashes = {size: np.unique(np.array(h, np.uint64)) for size, h in by_size.items()}

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
        """For each text: words, merged word spans [start, end) that windows cover, ids of the items found."""
        split = [plain_words(t) for t in texts]
        flat: list[bytes] = []
        starts = []
        for words in split:
            starts.append(len(flat))
            flat += words
            flat.append(b"")  # no word: windows end at a text's end
        number = self.numbers.get
        ids = np.fromiter((number(w, 0) for w in flat), np.int64, len(flat))
        outside = np.append(0, np.cumsum(ids == 0))
        rolled = np.append(np.zeros(1, np.uint64), np.cumsum(self.values[ids] * _powers(_INVERSE, len(ids)), dtype=np.uint64))
        powers = _powers(_BASE, len(ids))
        found: dict[int, list[tuple[int, int, set]]] = defaultdict(list)
        for size, hashes in self.hashes.items():
            if size > len(ids):
                continue
            at = np.flatnonzero(outside[size:] == outside[:-size])
            h = (rolled[at + size] - rolled[at]) * powers[at]
            for i in at[np.isin(h, hashes)]:
                if items := self.items.get(tuple(flat[i : i + size])):
                    k = int(np.searchsorted(starts, i, side="right")) - 1
                    found[k].append((int(i) - starts[k], int(i) - starts[k] + size, items))
        for k, words in enumerate(split):
            spans: list[tuple[int, int]] = []
            for start, end, _ in sorted(found.get(k, []), key=lambda x: x[:2]):
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((start, end))
            yield len(words), spans, sorted(set().union(*(x[2] for x in found.get(k, []))))


def result_names(docs: DataFrame) -> list[str]:
    """What ``scan`` calls the words, spans and items of ``docs``."""
    return [fresh(docs.columns, name) for name in ("_words", "_spans", "_items")]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = 500_000, clean: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``_words``, ``_spans`` (arrays of start and end word) and ``_items`` (of item_id's type).

    The benchmark is split into blocks of about ``most_windows`` windows; each block is one pass.
    With ``clean`` the last pass gives the columns of ``docs`` only, as ``decontaminated`` says.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // (4 * most_windows)  # a word takes more than four bytes, or makes fewer windows than this allows for
    names, more = docs.columns, result_names(docs)
    at = names.index("text")
    kind = benchmark.schema["item_id"].dataType
    out = docs.withColumns(dict(zip(more, (F.lit(0).cast("long"), F.array().cast("array<array<long>>"), F.array().cast(T.ArrayType(kind))), strict=True)))
    schema = out.schema
    ids = pa.list_({"string": pa.string(), "int": pa.int32()}.get(kind.simpleString(), pa.int64()))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r["item_id"], bytes(r["text"])) for r in rows], window))

        last = clean and block == blocks - 1

        def run(batch: pa.RecordBatch, shared=shared, last=last) -> pa.RecordBatch:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            old = zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)
            words, spans, items = [], [], []
            for a, b in slices(texts):
                for n, s, i in shared.value.scan(texts[a:b]):
                    before, seen = next(old)
                    words.append(n)
                    spans.append(_merged([*before, *s]))
                    items.append(sorted({*seen, *i}))
            if last:
                return _cleaned(batch, names, texts, words, spans)
            long = pa.int64()
            return pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(words, long), pa.array(spans, pa.list_(pa.list_(long))), pa.array(items, ids)], names=[*names, *more])

        out = out.mapInArrow(per_batch(run), docs.schema if last else schema)
        if blocks > 1:
            out = spill(out, "scan")
    return out


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def hit_words():
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(share: int = 20):
    """A hit, and at least one word in ``share`` is one."""
    return (hit_words() > 0) & (share * hit_words() >= F.col("_words"))


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    plain = raw.translate(_KEPT)
    at = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
    for start, end in sorted(map(tuple, spans), reverse=True):
        raw = raw[: at[start][0]] + raw[at[end - 1][1] :]
    return raw.decode()


_KEPT = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def _cleaned(batch: pa.RecordBatch, names: list[str], texts: list[bytes], words: list[int], spans: list) -> pa.RecordBatch:
    """The rows that are not contaminated, without their hit spans."""
    hits = [sum(b - a for a, b in s) for s in spans]
    kept = [k for k, h in enumerate(hits) if not h or 20 * h < words[k]]
    rows = batch.take(pa.array(kept, pa.int64()))
    columns = list(rows.columns[: len(names)])
    if any(hits[k] for k in kept):
        at = names.index("text")
        done = [without_spans(texts[k].decode(), spans[k]) if hits[k] else t for k, t in zip(kept, columns[at].to_pylist(), strict=True)]
        columns[at] = pa.array(done, columns[at].type)
        if "n_chars" in names:
            at = names.index("n_chars")
            sizes = [len(t) if hits[k] else n for k, t, n in zip(kept, done, columns[at].to_pylist(), strict=True)]
            columns[at] = pa.array(sizes, columns[at].type)
    return pa.RecordBatch.from_arrays(columns, names=names)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, and without the passages that others share with the benchmark."""
    return scan(docs, benchmark, clean=True)
