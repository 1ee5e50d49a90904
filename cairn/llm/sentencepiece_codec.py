"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice has an edge for every vocabulary piece; the search keeps, for each of the last positions that
a piece can still start from, the best path's score, its last piece and a backpointer.  Ids are committed as soon as
the surviving backpointer paths meet in one boundary, so the window is bounded by the longest piece
however long the text.

Models of two kinds are searched.  A unigram model's path has the largest sum of piece scores.  A byte-fallback BPE
model's piece scores are ranks of merges: its encoding of a prefix is the one path whose neighbouring pieces all stay
apart under the merge rules, so an edge is admissible when its piece and the path's last one are such a pair, and every
admissible path to a boundary is the best one; with that the ids equal the library's.

A text is read in windows cut where no piece can cross; short segments between such places are remembered.

Cases: a null or empty text has no ids; a very long text takes its own size, its ids' and a window's; characters without
a piece, and the space mark itself, become byte pieces, so decoding gives back every text exactly; of paths with equal
sums (ties) the one with the longer last piece stays; repeated rows are each encoded; an empty table stays empty; extra
columns pass through ``encoded``, and where one has the name of a result column, the result's name gets an underscore
before it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import fresh, slices

#: The model's place is a parameter; only the driver reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a space mark that a text holds itself; no valid text has a lone surrogate.
_LITERAL = "\udcff"
#: Pieces never hold a space mark after another character, nor a line end, so the search may restart there.
_SEGMENTS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Characters of a window, about.
_WINDOW = 1 << 16
#: A character without a piece scores this much less than the least piece of a unigram model.
_UNKNOWN = 10.0
#: Longest segment kept in the tables of known segments, and how many each of the two holds.
_SHORT, _REMEMBERED = 64, 250_000


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float]], special: dict[int, str], unigram: bool = False):
        """``pieces``: text and score of each id; ``special``: kind ("byte" or "control") of ids that no text matches."""
        self.unigram = unigram
        self.bytes = {int(p[3:5], 16): i for i, (p, _) in enumerate(pieces) if special.get(i) == "byte"}
        self.names = [p for p, _ in pieces]
        self.points = [s for _, s in pieces]
        self.raw = [bytes([int(p[3:5], 16)]) if special.get(i) == "byte" else b"" if i in special else p.replace(MARK, " ").encode() for i, (p, _) in enumerate(pieces)]
        self.score = {p: s for i, (p, s) in enumerate(pieces) if i not in special}
        self.id = {p: i for i, (p, _) in enumerate(pieces) if i not in special}
        self.longest = max(map(len, self.id))
        inner = {p for p in self.id if len(p.strip(MARK)) and (MARK in p.lstrip(MARK) or "\n" in p)}
        if inner:
            raise ValueError(f"pieces that cross words: {sorted(inner)[:3]}")
        self.trie: dict = {}  # character to the node after it; under 0 the id of the piece that ends in a node
        made: dict[str, int] = {}
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}
        for p in sorted(self.id, key=len):
            halves = [] if unigram else self.merged(p, 2)
            if not unigram and len(p) > 1 and (len(halves) != 2 or not all(h in made for h in halves)):
                continue  # the merges never make this piece
            i, spine = self.id[p], [self.id[h] for h in halves] if len(halves) > 1 else []
            self.left[i] = [*(self.left[spine[0]] if spine else []), i]
            self.right[i] = [*(self.right[spine[1]] if spine else []), i]
            made[p] = i
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[0] = i
        self.unknown = min(self.score.values()) - _UNKNOWN
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}  # segments seen lately
        self.older: dict[str, bytes] = {}  # and before those

    @classmethod
    def load(cls, model: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = {i: "byte" if sp.is_byte(i) else "control" for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        # ranks of merges are whole numbers, log probabilities are not
        return cls(pieces, special, any(score != int(score) for k, (_, score) in enumerate(pieces) if k not in special))

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The merge rules applied one by one, down to ``until`` parts: of all neighbours that form a piece, the best, leftmost first."""
        parts = list(text)
        while len(parts) > until:
            best = max(((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of two neighbouring pieces' characters end in just these two pieces.

        While either grows, in the order of scores, its edge facing the other runs through the spine of its
        merge tree; the two join if at some time the joined edges are a piece that is due before both next steps.
        """
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            right, left, names, points, i, j, known = self.right[a], self.left[b], self.names, self.points, 0, 0, True
            while True:
                due_a = points[right[i + 1]] if i + 1 < len(right) else -np.inf
                due_b = points[left[j + 1]] if j + 1 < len(left) else -np.inf
                joined = self.score.get(names[right[i]] + names[left[j]])
                if joined is not None and joined > due_a and joined >= due_b:
                    known = False
                    break
                if due_a == due_b == -np.inf:
                    break
                if due_a >= due_b:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def encode_segment(self, segment: str) -> bytes:
        """Little-endian 32-bit ids of a segment."""
        stream, out = Stream(self), []
        for at in range(0, len(segment), _WINDOW):
            ids = stream.feed(segment[at : at + _WINDOW].replace(MARK, _LITERAL).replace(" ", MARK))
            if ids:
                out.append(struct.pack(f"<{len(ids)}i", *ids))
        ids = stream.finish()
        out.append(struct.pack(f"<{len(ids)}i", *ids))
        return b"".join(out)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}, "apart": {}}

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return b"".join(self.windows(text))

    def windows(self, text: str) -> Iterator[bytes]:
        """The ids of a text, window by window."""
        at, first = 0, " "  # the mark that stands before a text
        while at < len(text):
            end = _cut(text, at + _WINDOW)
            yield self._encode(first + text[at:end])
            at, first = end, ""

    def _encode(self, text: str) -> bytes:
        known, older, out = self.known, self.older, []
        for segment in _SEGMENTS.findall(text):
            ids = known.get(segment)
            if ids is None:
                ids = older.get(segment) or self.encode_segment(segment)
                if len(segment) <= _SHORT:
                    if len(known) >= _REMEMBERED:
                        self.older, self.known = known, {}
                        known, older = self.known, self.older
                    known[segment] = ids
            out.append(ids)
        return b"".join(out)

    def forget(self) -> None:
        """Give the memory of known segments back at a task's end: the worker lives on and runs other stages."""
        self.known, self.older, self.apart = {}, {}, {}

    def decode(self, ids) -> str:
        """The text that ``encode`` was given."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_bytes(self, ids: bytes) -> str:
        """The same for little-endian 32-bit ids, which are read in runs."""
        numbers, raw = np.frombuffer(ids, "<i4"), self.raw.__getitem__
        return b"".join(b"".join(map(raw, numbers[at : at + _WINDOW].tolist())) for at in range(0, len(numbers), _WINDOW)).decode("utf-8", "replace")[1:]


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on where a segment starts: at a line end, or at a space after another character."""
    while at < len(text):
        line, space = text.find("\n", at), text.find(" ", at)
        found = min((k for k in (line, space) if k >= 0), default=len(text))
        if found == line or found == len(text) or text[found - 1] != " ":
            return found
        at = found + 1
    return len(text)


class Stream:
    """Viterbi search over text that arrives in parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.text, self.done = vocabulary, "", 0
        #: of each boundary in the window: the best path's last piece (-1: none, a lone character) and where it starts (-1: no path)
        self.last, self.back = [-1], [0]
        #: and its score, of a unigram model
        self.best = [0.0]
        self.widest = 0

    def feed(self, part: str) -> list[int]:
        """Search through ``part``; the ids that are settled by now."""
        out: list[int] = []
        search = self._search_sums if self.v.unigram else self._search
        for at in range(0, len(part), 256):
            self.text += part[at : at + 256]
            search(len(self.text) - self.v.longest + 1)
            if self.done > 4 * self.v.longest:
                out += self._settled()
        return out

    def finish(self) -> list[int]:
        (self._search_sums if self.v.unigram else self._search)(len(self.text))
        ids = self._path(len(self.text))
        self.text, self.done, self.last, self.back, self.best = "", 0, [-1], [0], [0.0]
        return ids

    def _search(self, until: int) -> None:
        """Extend the paths that end before boundary ``until``; no piece from there on is in sight as a whole yet."""
        v, text, last, back, trie, apart = self.v, self.text, self.last, self.back, self.v.trie, self.v.apart
        n = len(text)
        last += [-1] * (n + 1 - len(last))
        back += [-1] * (n + 1 - len(back))
        for start in range(self.done, until):
            if start and back[start] < 0:
                continue
            before, node, end = last[start], trie, start
            while end < n:
                node = node.get(text[end])
                end += 1
                if node is None:
                    if end == start + 1:  # no piece: the character's bytes, which merge with nothing
                        last[end], back[end] = -1, start
                    break
                piece = node.get(0)
                if piece is None:
                    if end == start + 1:
                        last[end], back[end] = -1, start
                elif back[end] < 0:
                    ok = before < 0 or apart.get(before << 20 | piece)
                    if ok or (ok is None and v.stay_apart(before, piece)):
                        last[end], back[end] = piece, start
        self.done = max(self.done, until)
        self.widest = max(self.widest, n)

    def _search_sums(self, until: int) -> None:
        """The same for a unigram model: of all paths to a boundary the one of the largest sum stays."""
        v, text, last, back, best = self.v, self.text, self.last, self.back, self.best
        n = len(text)
        last += [-1] * (n + 1 - len(last))
        back += [-1] * (n + 1 - len(back))
        best += [-np.inf] * (n + 1 - len(best))
        for start in range(self.done, until):
            node, end, single = v.trie, start, False
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                piece = node.get(0)
                if piece is not None:
                    single |= end == start + 1
                    if best[start] + v.points[piece] > best[end]:
                        best[end], last[end], back[end] = best[start] + v.points[piece], piece, start
            if not single and best[start] + v.unknown > best[start + 1]:
                best[start + 1], last[start + 1], back[start + 1] = best[start] + v.unknown, -1, start
        self.done = max(self.done, until)
        self.widest = max(self.widest, n)

    def _settled(self) -> list[int]:
        """Cut the window at the last boundary that all surviving paths share, and give the ids before it."""
        alive = {end for end in range(self.done, len(self.text) + 1) if self.back[end] >= 0}
        while len(alive) > 1:  # step the farthest path back until one boundary is left
            end = max(alive)
            alive.remove(end)
            alive.add(self.back[end])
        cut = alive.pop()
        ids = self._path(cut)
        self.text, self.done, self.last = self.text[cut:], self.done - cut, self.last[cut:]
        self.back = [0, *(b - cut if b >= 0 else b for b in self.back[cut + 1 :])]
        self.best = [b - self.best[cut] for b in self.best[cut:]] if self.v.unigram else [0.0]
        return ids

    def _path(self, end: int) -> list[int]:
        out: list[list[int]] = []
        while end:
            start, piece = self.back[end], self.last[end]
            if piece >= 0:
                out.append([piece])
            else:
                char = self.text[start:end]
                out.append([self.v.bytes[b] for b in (MARK if char == _LITERAL else char).encode()])
            end = start
        return [i for ids in reversed(out) for i in ids]


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``docs``, ``ids`` (array of int), ``n_ids`` and ``round_trip`` (decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = docs.columns
    at = names.index("text")
    more = {fresh(names, k): t for k, t in (("ids", T.ArrayType(T.IntegerType())), ("n_ids", T.LongType()), ("round_trip", T.BooleanType()))}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in more.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for texts in slices_of(batch):
                yield one(v, texts)
        v.forget()

    def slices_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in slices([t.as_py() or "" for t in batch.column(at)]):
            yield batch.slice(a, b - a)

    def one(v: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        found = [v.encode(t) for t in texts]
        lengths = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<i4")
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat))
        back = [v.decode_bytes(x) == t for x, t in zip(found, texts, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(lengths), pa.array(back)], names=[*names, *more])

    return docs.mapInArrow(run, schema)


def decoded(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns and ``decoded``, the text of the column ``ids``."""
    shared = ids.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: shared.value.decode([] if x is None else x))

    return ids.withColumn("decoded", decode("ids"))
