"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Training counts every token of every training text.  The most frequent words are leaves of a tree of three
levels of classes, all others fall into tail leaves by the hash of their last two bytes.  The model is
P(class | context) * P(subclass | class, context) * P(leaf | subclass, context), and every level is a softmax
over summed weight rows of the same hashed features, joined with the node above: the word before, the word
two before (skip) and the pair of both (n-gram).  Within a tail leaf a word has its add-one share, exact,
which also leaves room for unseen words.

Training is synchronous: texts are dealt to folds by a hash of the row, each round sums over all tasks, for one fold at
common weights, the observed counts and those of one draw from the model for each token (its expectation is the exact
gradient), and one damped diagonal Newton step follows.  A draw is a function of the token, its context and its place,
and the sums are of whole numbers, so neither partitions nor the order of tasks change the model.

What the model learns grows with the text: leaves, and hash rows of each feature and level, are
``8 * tokens ** 0.4``, rounded to a power of two (4,096 at least).  The most frequent words, up to ``KNOWN`` of them or
as many as there are leaves, travel as a broadcast; rarer words meet their counts in a join by word.

Cases: null and empty texts are the end token alone; very long texts are read in pieces; repeated rows are each
counted and scored; rows with a null doc_id are held out of nothing (they train); doc_id may have any type; extra
columns are ignored, whatever their names; words of equal count (ties) are taken in byte order; an empty table
has no scores; with no training text every score is that of unseen tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import residue, spill, text_bytes
from .text import pieces

KNOWN = 1 << 17
LEAST_LEAVES, GROWTH, LEVELS = 1 << 12, 0.4, 3
#: One leaf in ``TAILS`` is of rare words.
TAILS = 16
#: Each training text is in one of the folds, and each fold is one round.
FOLDS = 8
#: Of a step: its first rate and how fast it falls, the pull to zero, the damping, and the most that a weight moves.
RATE, FALL, PULL, DAMP, MOST = 0.8, 0.3, 0.5, 8.0, 2.0
#: A weight's largest size, so that sums of four can be exponents of 32-bit numbers.
_LARGEST = 15.0
_STEP, _BLOCK = 1 << 13, 1 << 12
END = b"\n"  # no word holds a line end


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: how often each token stands in ``texts`` (column ``text``, binary), with the texts' ends."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for piece in pieces(t):
                    counts.update(piece.lower().split())
                counts[END] += 1
                if len(counts) > 400_000:
                    yield from flushed(counts)
                    counts = Counter()
        yield from flushed(counts)

    def flushed(counts):
        words, numbers = list(counts), list(counts.values())
        for k in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.binary()), pa.array(numbers[k : k + 50_000], pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def leaves_for(tokens: int) -> int:
    return max(LEAST_LEAVES, 1 << round(np.log2(8 * max(tokens, 1) ** GROWTH)))


class Known(dict):
    """Word to number; -1 for any other word, which is not remembered."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """The most frequent words by number, those below ``leaves - tails`` being leaves of their own, and sums of the counts."""

    number: Known
    count: np.ndarray  # log10(count + 1) of each known number
    leaf: np.ndarray  # leaf of each known number
    tail_size: np.ndarray  # log10(tokens + words + 1) of each tail leaf
    leaf_count: np.ndarray  # tokens of each leaf
    leaves: int
    total: int
    distinct: int

    @property
    def modelled(self) -> int:
        return self.leaves - self.leaves // TAILS

    @property
    def within(self) -> np.ndarray:
        """log10 P(word | leaf) of each known number."""
        return np.where(self.leaf < self.modelled, 0.0, self.count - self.tail_size[np.maximum(self.leaf - self.modelled, 0)])


def tail_of(word: bytes, leaves: int) -> int:
    return zlib.crc32(word[-2:]) % (leaves // TAILS)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What the model keeps of the counts: tables of the most frequent words, and sums."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(sums[0] or 0), int(sums[1])
    leaves = leaves_for(total)
    tails = leaves // TAILS
    # words by bins of their counts, from the top, while they are few enough: a sort would send every task's top to the driver
    size_class = F.floor(F.log2("n") * 8)
    least, taken = np.inf, 0
    for r in sorted(counts.groupBy(size_class.alias("bin")).count().collect(), reverse=True):
        taken += r["count"]
        if taken > max(KNOWN, leaves):
            break
        least = float(r["bin"])
    top = counts.where(size_class >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64)
    modelled = min(leaves - tails, len(words))
    last = F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")
    size, kinds = np.zeros(tails), np.zeros(tails)
    for r in counts.groupBy((F.crc32(last) % tails).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        size[r["k"]], kinds[r["k"]] = r["n"], r["words"]
    for w, c in zip(words[:modelled], n[:modelled], strict=True):  # words with a leaf of their own are in no tail
        k = tail_of(w, leaves)
        size[k] -= c
        kinds[k] -= 1
    leaf_count = np.zeros(leaves)
    leaf_count[:modelled] = n[:modelled]
    leaf_count[leaves - tails :] = size
    leaf = np.array([k if k < modelled else leaves - tails + tail_of(w, leaves) for k, w in enumerate(words)], np.int32)
    return Vocabulary(Known((w, k) for k, w in enumerate(words)), np.log10(n + 1.0), leaf, np.log10(size + kinds + 1), leaf_count, leaves, total, distinct)


class Tree:
    """The levels of classes over the leaves, and where the weights of each level lie in one flat array.

    A level has ``rows`` hashed rows for each of three features and a row for each node; a row has a weight for each child.
    """

    def __init__(self, leaves: int):
        bits = leaves.bit_length() - 1
        self.leaves, self.rows = leaves, leaves
        self.bits = [(bits + LEVELS - 1 - k) // LEVELS for k in range(LEVELS)]
        self.shifts = [sum(self.bits[k + 1 :]) for k in range(LEVELS)]
        self.nodes = [1 << sum(self.bits[:k]) for k in range(LEVELS)]
        self.sizes = [(3 * self.rows + n) << b for n, b in zip(self.nodes, self.bits, strict=True)]
        self.starts = np.append(0, np.cumsum(self.sizes))

    def start(self, leaf_count: np.ndarray) -> np.ndarray:
        """Weights that give each child its share of its node's tokens, whatever the context."""
        out = np.zeros(self.starts[-1], np.float32)
        for k, b in enumerate(self.bits):
            n = leaf_count.reshape(self.nodes[k], 1 << b, -1).sum(axis=2)
            n = n + np.maximum(0.5, 1e-9 * n.sum(axis=1, keepdims=True))
            out[self.starts[k + 1] - n.size : self.starts[k + 1]] = np.log(n / n.sum(axis=1, keepdims=True)).ravel()
        return out

    def contexts(self, leaf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A 64-bit value of each token's three features: texts of ``lengths`` tokens stand one after another in ``leaf``."""
        place = np.arange(len(leaf)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tag = leaf.astype(np.uint64) + np.uint64(1)  # zero stands for the start of a text
        one, two = (np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), tag])[: len(leaf)], np.uint64(0)) for k in (1, 2))
        out = np.stack([one, two + np.uint64(1 << 40), (one << np.uint64(20)) * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(1 << 41)])
        return out * np.uint64(0xC2B2AE3D27D4EB4F)

    def level(self, k: int, leaf: np.ndarray, contexts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """At level ``k``: the four rows of each token, and which child its leaf lies in."""
        above = leaf >> (self.shifts[k] + self.bits[k])
        node = (above.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        shift = np.uint64(65 - self.rows.bit_length())
        rows = []
        for f in range(3):
            h = contexts[f] ^ node
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
            rows.append((h >> shift).astype(np.int64) + f * self.rows)
        rows.append(above.astype(np.int64) + 3 * self.rows)
        return rows, (leaf >> self.shifts[k]) & ((1 << self.bits[k]) - 1)

    def table(self, k: int, flat: np.ndarray) -> np.ndarray:
        return flat[self.starts[k] : self.starts[k + 1]].reshape(-1, 1 << self.bits[k])


def potentials(weights: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of all children in each context, and their exponentials."""
    z = np.take(weights, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, mode="clip")
    return z, np.exp(z)


def drawn(e: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A child for each row of ``e``, with chances in proportion, by a fixed function of ``seed``."""
    u = seed * np.uint64(0xFF51AFD7ED558CCD)
    u = ((u ^ (u >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(41)).astype(np.float32) / np.float32(1 << 23)
    n = e.shape[1]
    up = e @ np.triu(np.ones((n, n), np.float32))  # running sums, in a fixed order
    below = (up <= (u * up[:, -1])[:, None]).astype(np.float32) @ np.ones(n, np.float32)
    return np.minimum(below.astype(np.int64), n - 1)


def sums_of(tree: Tree, weights: np.ndarray, parts) -> np.ndarray | None:
    """Observed counts and drawn ones of every weight over (leaves, lengths) of texts."""
    out = None
    for leaf, lengths in parts:
        out = np.zeros((2, tree.starts[-1]), np.int64) if out is None else out
        contexts = tree.contexts(leaf, lengths)
        place = np.arange(len(leaf)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        seeds = contexts[2] ^ (leaf.astype(np.uint64) << np.uint64(32)) ^ place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for k, b in enumerate(tree.bits):
            flat: list[list[np.ndarray]] = [[], []]
            for at in range(0, len(leaf), _STEP):
                here = slice(at, at + _STEP)
                rows, y = tree.level(k, leaf[here], contexts[:, here])
                guess = drawn(potentials(tree.table(k, weights), rows)[1], seeds[here] + np.uint64(k))
                for r in rows:
                    flat[0].append((r << b) + y)
                    flat[1].append((r << b) + guess)
            for kind in (0, 1):
                out[kind, tree.starts[k] : tree.starts[k + 1]] += np.bincount(np.concatenate(flat[kind]), minlength=tree.sizes[k])
    return out


def stepped(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, start: np.ndarray, turn: int) -> np.ndarray:
    """A damped diagonal Newton step towards the observed counts, and a little towards the starting weights."""
    move = RATE / (1 + FALL * turn) * (observed - expected - PULL * (weights - start)) / (expected + DAMP)
    return np.clip(weights + np.clip(move, -MOST, MOST), np.minimum(start, -_LARGEST), _LARGEST).astype(np.float32)


def _parts(batches, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leaves, lengths) of the texts of batches of coded texts, in runs of about ``most`` tokens."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for raw in batch.column(batch.num_columns - 1):
            held.append(np.frombuffer(raw.as_buffer(), np.int32))
            size += len(held[-1])
            if size > most:
                yield np.concatenate(held), np.array([len(x) for x in held])
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held])


def coded(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """For each row of doc_id, held_out, fold and text: its tokens, known ones, the parts of both scores that are no
    matter of context and need no rare word's count, its rare words with their numbers, and the leaf of each token.
    """
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def one(v: Vocabulary, within: np.ndarray, text: bytes) -> tuple:
        leaves, rare, base, fixed, known = [], Counter(), 0.0, 0.0, 0
        for words in _word_runs(text):
            number = np.fromiter(map(v.number.__getitem__, words), np.int64, len(words))
            new = np.flatnonzero(number < 0)
            if len(v.leaf):
                leaf = v.leaf[number]
                have = number[number >= 0] if len(new) else number
                base += float(v.count[have].sum())
                fixed += float(within[have].sum())
            else:
                leaf = np.zeros(len(words), np.int32)
            tails = [tail_of(words[i], v.leaves) for i in new.tolist()]
            leaf[new] = np.array(tails, np.int32) + v.modelled
            fixed -= float(v.tail_size[tails].sum()) if tails else 0.0
            rare.update(words[i] for i in new.tolist())
            known += len(number) - len(new)
            leaves.append(leaf)
        leaf = np.concatenate(leaves)
        return len(leaf), known, base, fixed, list(rare), list(rare.values()), leaf.tobytes()

    def run(batches):
        v = shared.value
        within = v.within
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [one(v, within, t) for t in part.column(3).to_pylist()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=["doc_id", "held_out", "fold", "n_tokens", "n_known", "base", "fixed", "words", "times", "leaves"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, fold int, n_tokens long, n_known long, base double, fixed double, words array<binary>, times array<long>, leaves binary"
    return rows.select("doc_id", "held_out", "fold", "text").mapInArrow(run, schema)


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text, piece by piece."""
    before: list[bytes] = []
    for piece in pieces(text):
        if before:
            yield before
        before = piece.lower().split()
    yield [*before, END]


def fit(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """The flat weights of the tree, from all coded ``texts`` that have a fold."""
    context = texts.sparkSession.sparkContext
    tree = Tree(v.leaves)
    weights = start = tree.start(v.leaf_count)
    blocks = -(-len(weights) // _BLOCK)
    # a table of sums for each core, whatever the number of files
    train = texts.select("fold", "leaves").coalesce(context.defaultParallelism)
    schema = "block int, sums binary"

    def block_of(k: int) -> slice:
        return slice(k * _BLOCK, min((k + 1) * _BLOCK, tree.starts[-1]))

    def blocked(sums: np.ndarray) -> pa.RecordBatch:
        rows = [(k, sums[:, block_of(k)]) for k in range(blocks)]
        rows = [(k, x.astype(np.int32 if x.max() < 1 << 31 else np.int64)) for k, x in rows if x.any()]
        rows = [(k, bytes([x.itemsize]) + x.tobytes()) for k, x in rows]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "sums"])

    for turn in range(FOLDS):
        shared = context.broadcast((weights, v.leaf_count))

        def counted(batches, shared=shared):
            sums = sums_of(tree, shared.value[0], _parts(batches))
            if sums is not None:
                yield blocked(sums)

        def moved(batches, shared=shared, turn=turn):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = sums.as_buffer().to_pybytes()
                    out[block] = out.get(block, 0) + np.frombuffer(raw, f"i{raw[0]}", offset=1).astype(np.int64)
            if out:
                weights, start = shared.value[0], tree.start(shared.value[1])
                after = [stepped(weights[here], *out[k].reshape(2, -1), start[here], turn).tobytes() for k in out for here in [block_of(k)]]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(after, pa.binary())], names=["block", "weights"])

        # one job a round, whatever the partitions: the tasks move the weights, and the driver gets these alone
        found = train.where(F.col("fold") == turn).mapInArrow(counted, schema).repartition(F.col("block")).mapInArrow(moved, "block int, weights binary").toArrow()
        shared.destroy()
        after, left = weights.copy(), set(range(blocks))
        for k, raw in zip(found.column("block").to_pylist(), found.column("weights"), strict=True):
            after[block_of(k)] = np.frombuffer(raw.as_buffer(), np.float32)
            left.remove(k)
        if len(left) < blocks:
            for k in left:  # blocks that no token met are only pulled
                after[block_of(k)] = stepped(weights[block_of(k)], np.zeros(1), np.zeros(1), start[block_of(k)], turn)
            weights = after
    return weights


def token_scores(tree: Tree, weights: np.ndarray, leaf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 P(leaf | context) of every token."""
    contexts, out = tree.contexts(leaf, lengths), np.zeros(len(leaf))
    for at in range(0, len(leaf), _STEP):
        here = slice(at, at + _STEP)
        for k in range(LEVELS):
            rows, y = tree.level(k, leaf[here], contexts[:, here])
            z, e = potentials(tree.table(k, weights), rows)
            out[here] += np.take(z.ravel(), (np.arange(len(y)) << tree.bits[k]) + y) - np.log(np.einsum("ij->i", e))
    return out / np.log(10)


def context_scores(texts: DataFrame, v: Vocabulary, weights: np.ndarray) -> DataFrame:
    """The coded ``texts`` without leaves and rare words, and ``model``, the sum of the tokens' scores in their contexts."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    tree = Tree(v.leaves)
    names = [c for c in texts.columns if c not in ("leaves", "words", "times")]

    def run(batches):
        for batch in batches:
            done = [np.add.reduceat(token_scores(tree, shared.value, leaf, lengths), np.cumsum(lengths) - lengths) for leaf, lengths in _parts([batch])]
            if done:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(done))], names=[*names, "model"])

    return texts.select(*names, "leaves").mapInArrow(run, texts.select(*names).schema.add("model", "double"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Texts whose crc32 of doc_id leaves 2 on division by 7 are held out of training.
    """
    held = F.coalesce(residue("doc_id", 7) == 2, F.lit(False))
    fold = F.when(~held, F.pmod(F.xxhash64("doc_id", text_bytes()), F.lit(FOLDS)).cast("int")).otherwise(-1)
    rows = docs.select("doc_id", held.alias("held_out"), fold.alias("fold"), text_bytes().alias("text"))
    counts = spill(word_counts(rows.where(~F.col("held_out"))), "counts")
    v = vocabulary(counts)
    # rows are numbered once, as they are written; later plans read the written table
    texts = spill(coded(rows, v).withColumn("r", F.monotonically_increasing_id()), "coded", "fold")
    weights = fit(texts, v)
    rare = texts.select("r", F.explode(F.arrays_zip("words", "times")).alias("w")).select("r", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    tail = rare.join(counts, "word").groupBy("r").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("tail"), F.sum("k").alias("found"))
    out = context_scores(texts, v, weights).join(tail, "r", "left")
    more = F.coalesce("tail", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("found"), F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1))).alias("base_score"), (F.col("model") + F.col("fixed") + more).alias("score"),
    )
