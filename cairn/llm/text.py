"""Tokenisation shared by the operators, on UTF-8 bytes.

Space-separated words are runs of anything but 0x20 and 0x09-0x0D: exactly what ``bytes.split()`` gives.
Plain words are runs of digits, ASCII letters (lower-cased) and bytes above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about ``most`` bytes, cut between words."""
    start = 0
    while len(text) - start > most:
        end = min((k for k in (text.find(c, start + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0), default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


class WordHashes(dict):
    """Word to its 64-bit hash, remembered for a bounded number of words."""

    def __init__(self, most: int = 250_000, seed: int = 0):
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit values (multiply and fold)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def repeated(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose key is there more than once, by key, then value.  Most keys are alone, so only the rest is sorted by both."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    same = keys[1:] == keys[:-1]
    several = np.append(False, same) | np.append(same, False) if len(keys) else np.zeros(0, bool)
    keys, values = keys[several], values[several]
    order = np.lexsort((values, keys))
    return keys[order], values[order]
