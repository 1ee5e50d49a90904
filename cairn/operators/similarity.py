"""Similarity orders: identical vectors folded, recursive clustering by centroids, greedy neighbours in leaves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _majority(v: np.ndarray) -> np.ndarray:
    """Bits set in more than half (rounded down) of the vectors."""
    bits = np.unpackbits(v.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits > len(v) // 2, bitorder="little").view(np.uint64)


def greedy(v: np.ndarray) -> list[int]:
    """An order that starts with the first vector and goes on to the nearest left; the first of equals, and any at distance one or less, wins."""
    left, rest, out = np.arange(1, len(v)), v[1:].copy(), [0]
    for n in range(len(left), 0, -1):
        d = _distance(rest[:n], v[out[-1]])
        k = int((d <= 1).argmax())
        k = k if d[k] <= 1 else int(d.argmin())
        out.append(int(left[k]))
        left[k : n - 1], rest[k : n - 1] = left[k + 1 : n], rest[k + 1 : n]
    return out


def _clusters(v: np.ndarray, most_distance: int, most_children: int) -> list[list[int]]:
    """Each vector goes to the first centroid near enough; centroids follow their members.

    Bits of members are counted as they come, so a vector costs the same however many came before it.
    """
    centroids = np.zeros((most_children, v.shape[1]), v.dtype)
    counts = np.zeros((most_children, 64 * v.shape[1]), np.int64)
    children: list[list[int]] = []
    for start in range(0, len(v), 4096):
        run = v[start : start + 4096]
        bits = np.unpackbits(np.ascontiguousarray(run).view(np.uint8), axis=1, bitorder="little")
        for i in range(len(run)):
            k = 0
            if n := len(children):
                d = np.bitwise_count(centroids[:n] ^ run[i]).sum(axis=1)
                k = int((d <= most_distance).argmax())
                if d[k] > most_distance:
                    k = n if n < most_children else int(d.argmin())
            if k == n:
                children.append([])
                centroids[k] = run[i]
            own = children[k]
            own.append(start + i)
            counts[k] += bits[i]
            if len(own) < 64 or not len(own) & 63:
                centroids[k] = np.packbits(counts[k] > len(own) // 2, bitorder="little").view(np.uint64)
    return children


def order(v: np.ndarray, weights: np.ndarray, most_distance: int = 128, most_size: int = 256, most_children: int = 64) -> list[int]:
    """Positions of the vectors in similarity order."""
    if len(v) <= most_size or most_distance <= 1:
        first = sorted(range(len(v)), key=lambda i: -int(weights[i]))
        return [first[k] for k in greedy(v[first])]
    parts = []
    for members in _clusters(v, most_distance, most_children):
        m = np.array(members)
        parts.append([members[k] for k in order(v[m], weights[m], most_distance // 2, most_size, most_children)])
    parts.sort(key=lambda p: -int(weights[p].sum()))
    ends = np.array([v[p[0]] for p in parts])
    return [i for k in greedy(ends) for i in parts[k]]


def similarity_order(files: DataFrame, group: str, key: str, words: str, size: str) -> DataFrame:
    """(group, key, position): similarity order inside each group, which is one task as the order depends on all of it; equal vectors follow each other by falling size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_w=[tuple(w) for w in rows[words]]).sort_values([size, key], ascending=[False, True])
        distinct = sorted(rows["_w"].unique())
        total = rows.groupby("_w")[size].sum()
        v = np.array(distinct, np.int64).view(np.uint64).reshape(len(distinct), -1)
        rank = {distinct[i]: p for p, i in enumerate(order(v, np.array([total[w] for w in distinct])))}
        rows = rows.assign(_r=rows["_w"].map(rank)).sort_values(["_r", size, key], ascending=[True, False, True])
        return pd.DataFrame({group: rows[group], key: rows[key], "position": range(len(rows))})

    schema = files.select(group, key).schema.add("position", "long")
    return files.select(group, key, words, size).groupBy(group).applyInPandas(run, schema)
