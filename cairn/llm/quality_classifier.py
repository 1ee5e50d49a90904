"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Words and word pairs, the same of word shapes (letters, digits and signs collapsed), and the pair of a word
with itself hash into ``2**BITS`` features valued by their count over the root of the text's words.  One bounded task fits the
weights (FTRL-proximal); the table is then scored with one sparse dot product a document.

Cases: a null or empty text has only the bias; the features of a very long text are summed piece by piece; repeated
rows are each scored, and of rows that share a doc_id one trains, the least text; documents labelled both ways train
nothing; an empty table has no scores; doc_id may have any type; extra columns are ignored by ``quality_classifier``
and pass through ``scored``, whatever their names; without labels of both kinds every score is 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import training_labels
from .runtime import fresh, per_batch, residue, slices, text_bytes
from .text import WordHashes, mixed, pieces

BITS = 18
_SHAPES = [(re.compile(p), r) for p, r in ((rb"[A-Z]+", b"A"), (rb"[a-z\x80-\xff]+", b"a"), (rb"[0-9]+", b"0"))]


def _shape(word: bytes) -> bytes:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


class _Shapes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = WordHashes.__missing__(_shapes, _shape(word)) ^ 0x5BD1E995
        return h


_words, _shapes = WordHashes(seed=4), _Shapes(seed=5)


def forget_words() -> None:
    """Give the words' memory back at a task's end: the worker lives on and runs other stages."""
    _words.clear()
    _shapes.clear()


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature number of every n-gram, the weight of one occurrence, and where each text's features end.

    The first feature of a text is the bias.
    """
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    index, owners = _hashed(split)
    index, owners = np.append(np.full(len(texts), BIAS, np.int32), index), np.append(np.arange(len(texts)), owners)
    order = np.argsort(owners, kind="stable")
    index, owners = index[order], owners[order]
    value = (1 / np.sqrt(np.maximum(lengths, 1)))[owners]
    starts = np.searchsorted(owners, np.arange(len(texts)))
    value[starts] = 1.0
    return index, value, np.append(starts[1:], len(index))


def _hashed(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of every word, pair and repeat of texts of words, and the text each is from."""
    flat = [w for words in split for w in words]
    owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
    inner = owner[1:] == owner[:-1]
    parts, owners = [], []
    for h in (_words.of(flat), _shapes.of(flat)):
        parts += [h, mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inner]]
        owners += [owner, owner[1:][inner]]
    same = inner & (parts[0][1:] == parts[0][:-1])  # a word that follows itself, whichever it is
    parts.append(np.full(np.count_nonzero(same), 0x1F83D9ABFB41BD6B, np.uint64))
    owners.append(owner[1:][same])
    return (mixed(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owners)


#: The feature number of the bias.
BIAS = int(mixed(np.zeros(1, np.uint64))[0] >> np.uint64(64 - BITS))
#: Bytes beyond which a text is scored piece by piece.
LONG = 1 << 20


def long_margin(text: bytes, weights: np.ndarray) -> float:
    """The margin of a very long text, from sums over pieces of it that share their edge words."""
    total, words, last = 0.0, 0, []
    for piece in pieces(text, LONG):
        split = piece.split()
        if split:
            total += float(weights[_hashed([last + split])[0]].sum(dtype=float)) - (float(weights[_hashed([last])[0]].sum(dtype=float)) if last else 0.0)
            words, last = words + len(split), split[-1:]
    return float(weights[BIAS]) + total / max(words, 1) ** 0.5


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over (distinct features, values, label) rows."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v, y = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(1 << BITS)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, most_training_rows: int = 6_000) -> np.ndarray | None:
    """Weights from at most ``most_training_rows`` labelled documents whose crc32 is no multiple of 5; None without both labels."""
    chosen = training_labels(labels, most_training_rows)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column(1).to_pylist(), []
        for a, b in slices(texts):
            index, value, ends = features_of(texts[a:b])
            for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                i, inverse = np.unique(index[start:end], return_inverse=True)
                out.append({"i": i, "v": np.bincount(inverse, value[start:end]).astype(np.float32)})
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([x["i"] for x in out], pa.list_(pa.int32())), pa.array([x["v"] for x in out], pa.list_(pa.float32()))], names=["doc_id", "y", "i", "v"]
        )

    def trained(batches):
        rows = sorted(((d, y, i.tobytes(), v.tobytes()) for b in batches for d, y, i, v in _rows(b)), key=lambda r: (r[0], r[2]))
        labelled = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), float(y)) for _, y, i, v in rows]
        if len({y for _, _, y in labelled}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([fit_ftrl(labelled).tobytes()])], names=["w"])

    one = sample.mapInArrow(per_batch(counted), "doc_id string, y int, i array<int>, v array<float>").repartition(1)
    found = one.mapInArrow(trained, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32) if found else None


def _rows(batch: pa.RecordBatch):
    for d, y, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
        yield d, y, i.values.to_numpy(), v.values.to_numpy()


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in slices(texts):
        if len(texts[a]) > LONG:
            out[a] = long_margin(texts[a], weights)
        else:
            index, value, ends = features_of(texts[a:b])
            out[a:b] = np.add.reduceat(weights[index] * value, np.append(0, ends[:-1]))
    return out


def scored(docs: DataFrame, weights: np.ndarray | None, into: str = "_score") -> DataFrame:
    """All columns of ``docs`` and ``into``, the score (0 to 1); a column of that name must not be there (see ``fresh``)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            if shared.value is None:
                yield pd.Series(np.ones(len(text)))
            else:
                yield pd.Series(1 / (1 + np.exp(-np.clip(margins(text.tolist(), shared.value), -30, 30))))
        forget_words()

    return docs.select("*", score(text_bytes()).alias(into))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns as they are."""
    into = fresh(docs.columns, "score")
    return scored(docs, fit(docs, labels), into).where(F.col(into) >= threshold).select(*docs.columns)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_training_rows: int = 6_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, most_training_rows))
    held = F.coalesce(residue("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
