"""Segmentation: ordered contents into chunks of blocks, reusing data that recent blocks already hold.

A step-wise index of window hashes covers the active blocks; each content is scanned window by window, and
a verified match, extended both ways, becomes a reference instead of new data.  Choices depend on earlier
ones, so a stream is one ordered fold.  ``bucketed`` bounds the streams: consecutive contents of a category
form buckets of about equal bytes, each folded on its own, at the price of matches across buckets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import constant_hash, rolling_hashes
from .packing import stream_offsets


@dataclass(frozen=True)
class Config:
    window_bits: int = 12
    shift: int = 1
    block_bits: int = 22
    lookback: int = 1
    granularity: int = 1

    @property
    def window(self) -> int:
        w = 1 << self.window_bits if self.window_bits and self.lookback else 0
        return w - w % self.granularity

    @property
    def step(self) -> int:
        return max(1, self.window >> self.shift)

    @property
    def capacity(self) -> int:
        return (1 << self.block_bits) - (1 << self.block_bits) % self.granularity


def memory_estimate(c: Config, bloom_bits: int = 4) -> int:
    """Bytes that a stream's index takes at most: window hashes of the active blocks at 19 bytes each, and the filters.

    A filter has ``2 ** bloom_bits`` bits for each window of all blocks together, whose number is rounded up to a power
    of two; with several blocks each has one, besides the common one.
    """
    if not c.lookback or not c.window:
        return 0
    frames = (1 << c.block_bits) // c.granularity
    places = (frames - c.window + c.step) // c.step
    windows = c.lookback * (frames // c.step)
    bloom = (1 << bloom_bits + max(windows - 1, 0).bit_length()) // 8
    return c.lookback * (19 * places + (bloom if c.lookback > 1 else 0)) + bloom


@dataclass
class _Block:
    number: int
    data: bytearray = field(default_factory=bytearray)
    index: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    constants: set[int] = field(default_factory=set)  # bytes whose constant window is indexed


class Segmenter:
    #: Places of the table that tells which window hashes the index may hold.
    MARKS = 1 << 18

    def __init__(self, config: Config):
        self.c = config
        self.marks = np.zeros(self.MARKS, bool)
        self.piece = (-1, 0, 0)  # block, and where in it a content lies in one piece
        self.blocks = [_Block(0)]
        self.done: list[_Block] = []
        self.chunks: list[tuple] = []
        self.fresh: list[int] = []  # hashes indexed since this was last looked at
        self.foreign: list[int] = []  # those of windows that are not of one piece of the content
        self.stats = {"good": 0, "bad": 0, "reused": 0}
        self.constant = {constant_hash(b, config.window): b for b in range(256)} if config.window else {}

    def _emit(self, key, block: int, offset: int, size: int) -> None:
        if size:
            last = self.chunks[-1] if self.chunks else None
            if last and last[0] == key and last[2] == block and last[3] + last[4] == offset:
                self.chunks[-1] = (*last[:4], last[4] + size)
            else:
                self.chunks.append((key, last[1] + 1 if last and last[0] == key else 0, block, offset, size))

    def _mark(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ hashes >> 16) & self.MARKS - 1

    def _append(self, key, data: bytes, known: list[int] | None = None, at: int = 0, end: int | None = None) -> None:
        """Write ``data[at:end]``, cutting at ends of blocks and indexing windows that end at multiples of the step.

        ``known`` has the hash of each window of ``data``; only windows that begin before what the block holds of it in one piece are hashed here.
        """
        w, step = self.c.window, self.c.step
        end = len(data) if end is None else end
        while at < end:
            b = self.blocks[-1]
            start = len(b.data)
            part = data[at : min(end, at + self.c.capacity - start)]
            b.data += part
            self._emit(key, b.number, start, len(part))
            if w:
                first = max(w, start + 1)
                ends = range(first + -first % step, len(b.data) + 1, step)
                inside = at - start  # from a place in the block to the place in the data; a match changes it
                if self.piece[:2] != (b.number, inside):
                    self.piece = (b.number, inside, start)
                own = len(ends)
                if ends and known is not None:
                    own = min(own, max(0, -(-(self.piece[2] + w - ends[0]) // step)))
                before = []
                if own:
                    before = rolling_hashes(bytes(b.data[ends[0] - w : ends[own - 1]]), w)[::step].tolist()
                for k, e in enumerate(ends):
                    h = before[k] if k < own else known[e - w + inside]
                    byte = self.constant.get(h)
                    if byte is not None and b.data[e - w : e].count(byte) == w:
                        if byte in b.constants:
                            continue
                        b.constants.add(byte)
                    b.index[h].append(e - w)
                    (self.foreign if k < own else self.fresh).append(h)
                    self.marks[(h ^ h >> 16) & self.MARKS - 1] = True
            at += len(part)
            if len(b.data) >= self.c.capacity:
                self.done.append(b)
                self.blocks.append(_Block(b.number + 1))
                self.blocks = self.blocks[-max(1, self.c.lookback) :]
                self.marks[:] = False  # hashes of a block that is no longer active go
                for active in self.blocks:
                    self.marks[self._mark(np.fromiter(active.index, np.int64, len(active.index)))] = True

    def _match(self, data: bytes, at: int, h: int, written: int):
        """The longest verified match of the window at ``at``: (size, block, offset, bytes before the window)."""
        w, g, best = self.c.window, self.c.granularity, None
        for b in self.blocks:
            for offset in b.index.get(h, ()):
                if b.data[offset : offset + w] != data[at : at + w]:
                    self.stats["bad"] += 1
                    continue
                back = 0
                while offset - back >= g and at - back - g >= written and b.data[offset - back - g : offset - back] == data[at - back - g : at - back]:
                    back += g
                ahead = w
                limit = min(len(b.data) - offset, len(data) - at)
                while ahead + g <= limit and b.data[offset + ahead : offset + ahead + g] == data[at + ahead : at + ahead + g]:
                    ahead += g
                best = max(best or (0,), (back + ahead, b.number, offset - back, back))
        return best

    def add(self, key, data: bytes) -> None:
        """Scan a content.  Only positions whose window hash the index has, or gets while the content is written, are tried."""
        w, g, step = self.c.window, self.c.granularity, self.c.step
        self.piece = (-1, 0, 0)
        if not w or len(data) < w:
            self._append(key, data)
            return
        hashes = rolling_hashes(data, w)
        listed = hashes.tolist()
        may = np.flatnonzero(self.marks[self._mark(hashes)]).tolist()
        waiting = [p for p in may if any(listed[p] in b.index for b in self.blocks)]  # sorted, so a heap
        # a hash of a window of this content waits for its other places only if there are any
        ordered = np.sort(hashes)
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        again: dict[int, list[int]] = defaultdict(list)
        if len(repeated):
            for p in np.flatnonzero(np.isin(hashes, repeated)).tolist():
                again[listed[p]].append(p)
        places_of: dict[int, int] = {}
        asked = 0
        at = written = 0
        self.fresh.clear()
        self.foreign.clear()

        def place_of(h: int) -> int:
            """Of a hash that one window of the content has; -1 if none."""
            nonlocal asked
            asked += 1
            if asked < 16:
                return int(found[0]) if len(found := np.flatnonzero(hashes == h)) else -1
            if not places_of:
                places_of.update(zip(listed, range(len(listed)), strict=True))
            return places_of.get(h, -1)

        def write(end: int) -> None:
            nonlocal written
            self._append(key, data, listed, written, end)
            written = end
            # a window of the content itself ends before ``at``, so only its repetitions wait
            for h in self.fresh if again else ():
                if h in again:
                    for p in again[h][bisect_left(again[h], at) :]:
                        heappush(waiting, p)
            for h in self.foreign:
                if h in again:
                    for p in again[h][bisect_left(again[h], at) :]:
                        heappush(waiting, p)
                elif (p := place_of(h)) >= at:
                    heappush(waiting, p)
            self.fresh.clear()
            self.foreign.clear()

        flush = w + step  # what is far enough behind the window is written, up to where the next index entry falls
        while True:
            while waiting and (waiting[0] < at or (waiting[0] - at) % g):
                heappop(waiting)
            next_match = waiting[0] if waiting else len(data)
            at = min(next_match, max(at, flush))
            if at + w > len(data):
                break
            if at >= flush:
                room = at - written - step
                room -= (len(self.blocks[-1].data) + room) % step
                room -= room % g
                if room > 0:
                    write(written + room)
                flush = max(written + w + step, at + g)
                continue
            heappop(waiting)
            if found := self._match(data, at, listed[at], written):
                size, block, offset, back = found
                write(at - back)
                self._emit(key, block, offset, size)
                self.stats["good"] += 1
                self.stats["reused"] += size
                at = written = at - back + size
                flush = written + w + step
        self._append(key, data, listed, written)

    def finish(self) -> list[tuple[int, bytes]]:
        last = self.blocks[-1]
        return [(b.number, bytes(b.data)) for b in [*self.done, *([last] if last.data else [])]]


def bucketed(files: DataFrame, category: str, order: list[str], size: str, most: int) -> DataFrame:
    """``bucket`` within the category: runs of consecutive contents of about ``most`` bytes."""
    return stream_offsets(files, category, order, size).withColumn("bucket", F.floor(F.col("low") / most)).drop("low", "high")


def segment(files: DataFrame, config: Config, rank: str = "rank") -> tuple[DataFrame, DataFrame]:
    """(chunks, blocks) of files (key, category, bucket, rank, content): one fold for each bucket, in order of rank."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        s = Segmenter(config)
        rows = rows.sort_values([rank, "key"])
        for key, content in zip(rows["key"], rows["content"], strict=True):
            s.add(key, content or b"")
        category, bucket = rows["category"].iloc[0], rows["bucket"].iloc[0]
        chunks = [(category, bucket, "chunk", k, o, b, at, n, None) for k, o, b, at, n in s.chunks]
        blocks = [(category, bucket, "block", None, None, b, 0, len(data), data) for b, data in s.finish()]
        return pd.DataFrame(chunks + blocks, columns=["category", "bucket", "kind", "key", "ord", "block", "offset", "size", "data"]).astype({"key": "Int64", "ord": "Int64"})

    schema = "category string, bucket long, kind string, key long, ord long, block long, offset long, size long, data binary"
    out = files.select("key", "category", "bucket", rank, "content").groupBy("category", "bucket").applyInPandas(fold, schema)
    from ..scale import written

    out = written(out)
    return out.where("kind = 'chunk'").drop("kind", "data"), out.where("kind = 'block'").select("category", "bucket", "block", "size", "data")


def reassemble(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, content) from chunks and blocks."""
    joined = chunks.join(blocks.select("category", "bucket", "block", "data"), ["category", "bucket", "block"])
    part = F.struct("ord", F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("bytes"))
    parts = joined.select("key", F.struct(part["ord"].alias("ord"), F.hex(part["bytes"]).alias("hex")).alias("p"))
    return parts.groupBy("key").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["hex"]), "")).alias("content"))
