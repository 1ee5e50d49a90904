"""Language identification by hierarchical discrimination.

Texts are byte trigrams (ASCII letters lowered) hashed into ``2**BITS`` features and averaged.  Linear
one-against-rest machines name the family; within it one-versus-one linear support vector machines tell
its languages apart by votes, then margins.  Families of listed codes are fixed; any other code is a
family of its own.  All machines are trained together on a bounded sample and score together, as one
gather and one sum a text.

Cases: null texts and texts without a letter are ``und`` with score 0; very long texts count whole; with no labelled rows
every text is ``und``; repeated rows are each scored, and of rows that share doc_id and lang one trains, the least text;
equal votes go to the first language by name; an empty table has no predictions; doc_id may have any type; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import per_batch, residue, slices, text_bytes

BITS, SCALE = 16, 40.0
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tk tr uz",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
    "austronesian": "id jv ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts' trigrams, where each text's start, and how many it has (one at least)."""
    raw = np.frombuffer(b"".join(b" " + t.lower() + b" " + b" " * (len(t) == 0) for t in texts), np.uint8).astype(np.uint32)
    lengths = np.array([max(len(t), 1) + 2 for t in texts], np.int64)
    h = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    ends = np.cumsum(lengths)
    inside = np.ones(len(raw), bool)
    inside[ends - 1] = inside[ends - 2] = False
    counts = lengths - 2
    return h[inside[: len(h)]], np.cumsum(counts) - counts, counts


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, penalty: float = 1e-4) -> np.ndarray:
    """Weights (last one the bias) of a linear machine on the hinge loss, by averaged stochastic subgradients (Pegasos)."""
    w, total = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    scale, step, summed = 1.0, 0, 0
    weight = {1: len(y) / (2 * max(1, (y > 0).sum())), -1: len(y) / (2 * max(1, (y < 0).sum()))}
    order = np.random.default_rng(17)
    for epoch in range(epochs):
        for k in order.permutation(len(rows)):
            step += 1
            rate = 1 / (penalty * (step + 1 / penalty))
            i, v = rows[k]
            margin = y[k] * scale * (w[i] @ v)
            scale *= 1 - rate * penalty
            if margin < 1:
                w[i] += rate * weight[int(y[k])] * y[k] * v / scale
        if epoch >= epochs // 2:
            total += scale * w
            summed += 1
    return total / max(summed, 1)


@dataclass
class Hierarchy:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # features by machines: families first (if more than one), then pairs
    bias: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        members = {f: [k for k, lang in enumerate(self.langs) if family_of(lang) == f] for f in self.families}
        skip = len(self.families) if len(self.families) > 1 else 0
        for a, b in slices(texts):
            index, starts, counts = trigrams(texts[a:b])
            margins = np.add.reduceat(self.weights[index], starts, axis=0) * (SCALE / counts)[:, None] + self.bias
            chances = 1 / (1 + np.exp(-2 * np.clip(margins, -15, 15)))
            top = margins[:, :skip].argmax(axis=1) if skip else np.zeros(b - a, int)
            share = chances[:, :skip] / np.maximum(chances[:, :skip].sum(axis=1, keepdims=True), 1e-9) if skip else np.ones((b - a, 1))
            for f, family in enumerate(self.families):
                rows, own = np.flatnonzero(top == f), members[family]
                votes = np.zeros((len(rows), len(own)))
                close = np.zeros((len(rows), len(own)))
                for p, (x, y) in enumerate(self.pairs):
                    if x in own and y in own:
                        m, c = margins[rows, skip + p], chances[rows, skip + p]
                        for lang, sign, chance in ((x, 1, c), (y, -1, 1 - c)):
                            votes[:, own.index(lang)] += (sign * m > 0) + 1e-3 * np.tanh(sign * m)
                            close[:, own.index(lang)] += chance
                best = votes.argmax(axis=1)
                chance = close[np.arange(len(rows)), best] / (len(own) - 1) if len(own) > 1 else np.ones(len(rows))
                for r, k, s in zip(rows, best, share[rows, f] * chance, strict=True):
                    if has_letter(texts[a + r]):
                        names[a + r], scores[a + r] = self.langs[own[k]], s
        return names, np.clip(scores, 0, 1)


def fit(docs: DataFrame, most_each: int = 1_500) -> Hierarchy:
    """Machines from about ``most_each`` documents of each language (by a hash of doc_id) whose crc32 is no multiple of 5.

    Every value of lang is trained, in one task; a family and a pair within a family have 256 KB of weights each.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (residue("doc_id", 5) != 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Hierarchy([], [], [], np.zeros((1 << BITS, 0)), np.zeros(0))
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most_each / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = usable.where(draw < F.try_element_at(rate, F.col("lang"))).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", text_bytes().alias("text"))
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    langs = sorted(counts)
    families = sorted({family_of(x) for x in langs})
    pairs = [(x, y) for x, y in combinations(range(len(langs)), 2) if family_of(langs[x]) == family_of(langs[y])]

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        idx, val, texts = [], [], batch.column(2).to_pylist()
        for a, b in slices(texts):
            index, starts, counts = trigrams(texts[a:b])
            for s, n in zip(starts, counts, strict=True):
                i, c = np.unique(index[s : s + n], return_counts=True)
                idx.append(i.astype(np.int32))
                val.append((c * (SCALE / n)).astype(np.float32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["doc_id", "lang", "i", "v"])

    def trained(batches):
        got = [(d, lang, i.values.to_numpy(), v.values.to_numpy()) for b in batches for d, lang, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)]
        got.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        rows = [(np.append(i, 1 << BITS), np.append(v, np.float32(1))) for _, _, i, v in got]
        names = np.array([r[1] for r in got])
        kin = np.array([family_of(x) for x in names])
        tasks = [(np.arange(len(rows)), np.where(kin == f, 1, -1)) for f in families] if len(families) > 1 else []
        tasks += [(at := np.flatnonzero((names == langs[x]) | (names == langs[y])), np.where(names[at] == langs[x], 1, -1)) for x, y in pairs]
        for number, (at, y) in enumerate(tasks):
            w = fit_svm([rows[k] for k in at], y)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([w.astype(np.float32).tobytes()])], names=["number", "w"])

    one = sample.mapInArrow(per_batch(counted), "doc_id string, lang string, i array<int>, v array<float>").repartition(1)
    found = {r["number"]: np.frombuffer(r["w"], np.float32) for r in one.mapInArrow(trained, "number int, w binary").collect()}
    machines = np.stack([found[k] for k in sorted(found)], axis=1) if found else np.zeros(((1 << BITS) + 1, 0), np.float32)
    return Hierarchy(langs, families, pairs, np.ascontiguousarray(machines[:-1]), machines[-1].copy())


def language_id(docs: DataFrame, most_each: int = 1_500) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, most_each))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(residue("doc_id", 5) == 0, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held.alias("held_out"), text_bytes().alias("text")).mapInArrow(per_batch(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
