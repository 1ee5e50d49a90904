"""Quality rules: boosted trees over document statistics, after hard base rules.

``document_statistics`` computes exact statistics of every whole text; ``fit_trees`` trains
gradient-boosted trees with monotonic constraints; ``FlatTrees`` keeps them as numpy node arrays and
scores matrices.  ``quality_rules`` puts them together.

Cases: a null text is an empty one (no words, fails the base rules); very long texts count whole; repeated rows are each
judged, and of rows that share a doc_id one trains, that of the least features; documents labelled both ways train
nothing; labels are taken in the order of a hash of doc_id, ties by doc_id; an empty table has no verdicts; doc_id may have
any type; extra columns are ignored, whatever their names; without usable labels every document that passes the base
rules is kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import per_batch, residue, spill, text_bytes

_SPACE = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
_DIGITS = b"0123456789"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Inputs of the trees, each with its constraint: -1 means that a larger value never raises the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "other_share": -1, "distinct_share": 0, "line_words": 0, "end_share": 0, "longest_word": 0,
}
_MANY = 50_000


def _groups_of_five(words: list[bytes]) -> np.ndarray:
    """Exact ids of the 5-word windows, by pairing ids of shorter windows."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))

    def paired(a, b):
        return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]

    two = paired(ids[:-1], ids[1:])
    four = paired(two[:-2], two[2:])
    return paired(four[:-1], ids[4:])


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text holds twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) > _MANY and size == 5:
        ids = _groups_of_five(words)
        hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    else:
        windows = list(zip(*(words[i:] for i in range(size)), strict=False))
        counts = Counter(windows)
        if len(counts) == n:
            return 0
        hit = np.fromiter((i for i, w in enumerate(windows) if counts[w] > 1), np.int64)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics_of(text: bytes) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUED))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = duplicates = ended = 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
            ended += bare[-1:] in b".!?:"
    repeats = repeated_words(words)
    w, c = max(n, 1), max(chars, 1)
    upper = len(text) - len(text.translate(None, _UPPER))
    digits = len(text) - len(text.translate(None, _DIGITS))
    other = len(text.translate(None, _LETTERS + _DIGITS + _SPACE))
    features = [
        np.log1p(n), chars / w, symbols / c, duplicates / max(lines, 1), repeats / w, upper / c,
        digits / c, other / c, len(set(words)) / w, n / max(lines, 1), ended / max(lines, 1), np.log1p(max(map(len, words), default=0)),
    ]
    return [n, chars, symbols, duplicates, repeats], features


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts and ``features`` (array of double) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics_of(t) for t in batch.column(1).to_pylist()]
        counts = np.array([x[0] for x in found], np.int64).reshape(-1, len(COUNTS))
        features = pa.array([x[1] for x in found], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T), features], names=["doc_id", *COUNTS, "features"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(per_batch(run), schema)


@dataclass
class FlatTrees:
    """All trees in one set of node arrays; a leaf points at itself, so ``depth`` steps reach it from anywhere."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> FlatTrees:
    """Histogram gradient boosting on the logistic loss.

    A split of a constrained feature is allowed only if its leaf values are in order, and the middle of
    the two bounds everything below on either side, so each tree, and their sum, is monotone.
    """
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(n, bias)
    nodes: list[list] = []
    roots = []

    def grow(rows, g, h, level, low, high) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        nodes.append([0, np.inf, at, at, rate * value])
        if level == depth or len(rows) < 2:
            margin[rows] += rate * value
            return at
        best = (1e-6, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(m):
            size = len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
            gr, hr = gs - gl, hs - hl
            a, b = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            # loss of a bounded leaf value v: G v + (H + l2) v^2 / 2
            gain = (gs * value + (hs + l2) * value**2 / 2) - (gl * a + (hl + l2) * a**2 / 2) - (gr * b + (hr + l2) * b**2 / 2)
            ok = (hl >= least / 4) & (hr >= least / 4) & (monotone[j] * (b - a) >= 0)
            if ok.any() and (top := np.where(ok, gain, -1)).max() > best[0]:
                k = int(top.argmax())
                best = (float(top[k]), (j, k, float(a[k]), float(b[k])))
        if best[1] is None:
            margin[rows] += rate * value
            return at
        j, k, a, b = best[1]
        middle, goes = (a + b) / 2, binned[rows, j] <= k
        lo_hi = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
        nodes[at][:2] = [j, float(cuts[j][k])]
        nodes[at][2] = grow(rows[goes], g, h, level + 1, *lo_hi[0])
        nodes[at][3] = grow(rows[~goes], g, h, level + 1, *lo_hi[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
    return FlatTrees(f.astype(np.int64), t.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float), np.array(roots), depth, bias)


def training_labels(labels: DataFrame, most: int, modulus: int = 5) -> DataFrame:
    """At most ``most`` documents with one quality label, in the order of a hash, none whose crc32 is a multiple of ``modulus``."""
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (residue("doc_id", modulus) != 0))
        .groupBy(F.col("doc_id").cast("string").alias("doc_id"))
        .agg(F.min("quality").alias("y"), F.max("quality").alias("_y"))
        .where(F.col("y") == F.col("_y"))
    )
    return one.select("doc_id", F.col("y").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def quality_rules(docs: DataFrame, labels: DataFrame, most_training_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Every document with its base counts, ``base_failed``, the trees' ``score`` and ``kept``.

    The trees are fitted on at most ``most_training_rows`` labelled documents (features only reach the driver);
    statistics and scores cover all documents.
    """
    stats = spill(document_statistics(docs), "rules")
    chosen = training_labels(labels, most_training_rows).withColumnRenamed("doc_id", "id")
    sample = stats.join(F.broadcast(chosen), stats["doc_id"].cast("string") == F.col("id")).groupBy("id", "y").agg(F.min("features").alias("features")).orderBy("id").toPandas()
    trees = None
    if sample["y"].nunique() == 2:
        trees = fit_trees(np.array(sample["features"].tolist(), float), sample["y"].to_numpy(float), list(FEATURES.values()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
        score = trees.score(x) if trees else np.ones(len(x))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=["doc_id", *COUNTS, "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.mapInArrow(per_batch(run), schema).select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
