"""Byte kernels in numpy: similarity hashes, rolling hashes, bit sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF


#: Shifts and multipliers of the public low-bias 32-bit mixer, and the offset before it.
MIX_SHIFTS, MIX_FACTORS, MIX_OFFSET = (16, 15, 15), (0x21F0AAAD, 0x735A2D97), 0x9E3779B9


def mix32(x: Column) -> Column:
    """The mixer in long arithmetic; products stay below 2**63 by halves of 16 bits."""
    for shift, factor in zip(MIX_SHIFTS, (*MIX_FACTORS, None), strict=True):
        x = x.bitwiseXOR(F.shiftright(x, shift))
        if factor:
            low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
            x = (low * F.lit(factor) + F.shiftleft((high * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))
    return x


#: Fixed value: permutation table of the public nilsimsa digest, by its generating rule.
def _nilsimsa_table() -> np.ndarray:
    table: list[int] = []
    j = 0
    for _ in range(256):
        j = (j * 53 + 1) % 256 * 2
        j -= 255 if j > 255 else 0
        while j in table:
            j = (j + 1) % 256
        table.append(j)
    return np.array(table, np.int64)


NILSIMSA = _nilsimsa_table()
#: The byte triples of a five-byte window (0 the newest) and the number of each.
TRIPLES = [(0, 1, 2, 0), (0, 1, 3, 1), (0, 2, 3, 2), (0, 1, 4, 3), (0, 2, 4, 4), (0, 3, 4, 5), (4, 1, 0, 6), (4, 3, 0, 7)]


def nilsimsa(data: bytes) -> np.ndarray:
    """The 256-bit digest as four unsigned words, lowest first."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n, counts, total = len(b), np.zeros(256, np.int64), 0
    for x, y, z, k in TRIPLES:
        reach = max(x, y, z)
        if n > reach:
            p, q, r = (b[reach - d : n - d] for d in (x, y, z))
            value = ((NILSIMSA[(p + k) & 255] ^ (NILSIMSA[q] * (2 * k + 1))) + NILSIMSA[r ^ NILSIMSA[k]]) & 255
            counts += np.bincount(value, minlength=256)
            total += n - reach
    bits = counts > total // 256
    return np.packbits(bits, bitorder="little").view("<u8")


def nilsimsa_hex(data: bytes) -> str:
    return "".join(f"{int(w):016x}" for w in nilsimsa(data)[::-1])


@F.pandas_udf(T.ArrayType(T.LongType()))
def nilsimsa_words(content: pd.Series) -> pd.Series:
    return content.map(lambda b: nilsimsa(b or b"").view(np.int64))


def rolling_hashes(data: bytes, window: int) -> np.ndarray:
    """The two-sum rolling hash of every window: a the sum of bytes, b the sum of sums, as a | b << 16."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(b) < window or window <= 0:
        return np.zeros(0, np.int64)
    plain = np.concatenate([[0], np.cumsum(b)])
    weighted = np.concatenate([[0], np.cumsum(b * np.arange(len(b)))])
    at = np.arange(len(b) - window + 1)
    a = plain[at + window] - plain[at]
    s = a * (at + window) - (weighted[at + window] - weighted[at])  # each byte counts once for each step it has stayed
    return (a & 0xFFFF) | (s & 0xFFFF) << 16


def constant_hash(byte: int, window: int) -> int:
    """The rolling hash of a window of one repeated byte."""
    return (window * byte & 0xFFFF) | (window * (window + 1) // 2 * byte & 0xFFFF) << 16


class BloomFilter:
    """One hash, a power of two of bits: bit ``h & 63`` of word ``h >> 6``."""

    def __init__(self, bits: int):
        self.words = np.zeros(max(1, bits // 64), np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        h = hashes.astype(np.uint64)
        np.bitwise_or.at(self.words, (h >> np.uint64(6)).astype(np.int64) & len(self.words) - 1, np.uint64(1) << (h & np.uint64(63)))

    def test(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.uint64)
        return (self.words[(h >> np.uint64(6)).astype(np.int64) & len(self.words) - 1] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)

    def merge(self, other: BloomFilter) -> None:
        self.words |= other.words


def digest_udf(algorithm: str):
    """A digest that Spark lacks, as lower-case hex (any of hashlib, xxh3-64, xxh3-128)."""

    @F.pandas_udf(T.StringType())
    def digest(content: pd.Series) -> pd.Series:
        if algorithm.startswith("xxh3"):
            import xxhash

            make = {"xxh3-64": xxhash.xxh3_64_hexdigest, "xxh3-128": xxhash.xxh3_128_hexdigest}[algorithm]
            return content.map(lambda b: make(b or b""))
        return content.map(lambda b: hashlib.new(algorithm, b or b"").hexdigest())

    return digest


def checksum(content: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex digest of bytes; in the JVM where Spark has it."""
    native = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}
    return native[algorithm](content) if algorithm in native else digest_udf(algorithm)(content)


def word_buckets(data: bytes) -> np.ndarray:
    """How many four-byte words of ``data`` fall into each of 256 buckets."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) < 4:
        return np.zeros(256, np.int64)
    mask = np.uint64(MASK)
    x = (b[:-3] << np.uint64(24) | b[1:-2] << np.uint64(16) | b[2:-1] << np.uint64(8) | b[3:]) + np.uint64(MIX_OFFSET) & mask
    for shift, factor in zip(MIX_SHIFTS, (*MIX_FACTORS, 1), strict=True):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor) & mask
    return np.bincount((x >> np.uint64(24)).astype(np.int64), minlength=256)


def similarity_of(data: bytes) -> int:
    """The four most frequent buckets, most frequent first, one byte each; ties and empty buckets in order of number."""
    top = np.argsort(-word_buckets(data), kind="stable")[:4]
    return int.from_bytes(bytes(top.astype(np.uint8)), "big")


@F.pandas_udf(T.LongType())
def similarity_hash(content: pd.Series) -> pd.Series:
    return content.map(lambda b: similarity_of(b or b""))
