"""Rice coding of 16-bit samples: zig-zag deltas of interleaved components, best split by block, raw fallback."""

from __future__ import annotations

import struct

import numpy as np


#: Samples that are coded at once, about; temporary arrays take some hundred bytes a sample.
RUN = 1 << 15


def _coded(own: np.ndarray, zigzag: np.ndarray, block: int) -> np.ndarray:
    """Bits of whole blocks, and of a short one at the end: the same steps for all blocks together."""
    n, starts = len(own), np.arange(0, len(own), block)
    lengths = np.minimum(block, n - starts)
    sizes = np.stack([np.add.reduceat(zigzag >> k, starts) + lengths * (1 + k) for k in range(16)])
    split = sizes.argmin(axis=0)
    raw = sizes[split, np.arange(len(starts))] >= 16 * lengths
    k = np.repeat(np.where(raw, 0, split), lengths)
    plain = np.repeat(raw, lengths)
    high = np.where(plain, 0, zigzag >> k)
    took = np.where(plain, 16, high + 1 + k)  # bits of each sample; each block has five bits before it
    ends = np.cumsum(took) + 5 * (np.arange(n) // block + 1)
    bits = np.zeros(int(ends[-1]), np.uint8)
    heads = (ends - took)[starts] - 5
    marks = np.where(raw, 31, split)
    for j in range(5):
        bits[heads + j] = marks >> (4 - j) & 1
    low = ends - k  # as many zeros as the high part, a one, then the low part
    bits[(low - 1)[~plain]] = 1
    for j in range(int(k.max(initial=0))):
        some = k > j  # the last bit is j = 0
        bits[ends[some] - 1 - j] = zigzag[some] >> j & 1
    for j in range(16 if raw.any() else 0):
        bits[ends[plain] - 1 - j] = own[plain] >> j & 1
    return bits


def encode(data: bytes, block: int = 128, components: int = 1) -> bytes:
    """A header of length, block size, components; then for each block five bits of split and its samples, or 31 and raw samples."""
    tail = data[len(data) - len(data) % 2 :]
    v = np.frombuffer(data[: len(data) - len(tail)], "<u2").astype(np.int64)
    out, rest = [], np.zeros(0, np.uint8)
    run = max(1, RUN // block) * block
    for c in range(components):
        own = v[c::components]
        d = np.diff(own, prepend=0)
        zigzag = np.where(d < 0, -2 * d - 1, 2 * d)
        for at in range(0, len(own), run):
            bits = np.concatenate([rest, _coded(own[at : at + run], zigzag[at : at + run], block)])
            whole = len(bits) - len(bits) % 8
            out.append(np.packbits(bits[:whole]).tobytes())
            rest = bits[whole:]
    packed = b"".join(out) + np.packbits(rest).tobytes()
    return struct.pack("<qHB", len(data), block, components) + bytes([len(tail)]) + tail + packed


def _value(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits at places."""
    out = np.zeros(len(at), np.int64)
    for j in range(width):
        out = out << 1 | bits[at + j]
    return out


def decode(payload: bytes) -> bytes:
    """Only the ends of the unary parts are found one after another; the rest is done by block."""
    size, block, components = struct.unpack_from("<qHB", payload)
    at = struct.calcsize("<qHB")
    tail = payload[at + 1 : at + 1 + payload[at]]
    packed = payload[at + 1 + len(tail) :]
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    text = bits.tobytes()
    n = (size - len(tail)) // 2
    v = np.zeros(n, np.int64)
    pos, one = 0, b"\x01"
    find = text.find
    for c in range(components):
        count, last = len(range(c, n, components)), 0
        own = np.zeros(count, np.int64)
        for start in range(0, count, block):
            m = min(block, count - start)
            k = text[pos] << 4 | text[pos + 1] << 3 | text[pos + 2] << 2 | text[pos + 3] << 1 | text[pos + 4]
            pos += 5
            if k == 31:
                own[start : start + m] = _value(bits, np.arange(pos, pos + 16 * m, 16), 16)
                pos += 16 * m
                last = int(own[start + m - 1])
                continue
            ones, step, first = [], k + 1, pos
            for _ in range(m):
                pos = find(one, pos)
                ones.append(pos)
                pos += step
            ends = np.array(ones, np.int64)
            high = np.diff(ends, prepend=first - step) - step
            z = high << k | _value(bits, ends + 1, k)
            own[start : start + m] = last + np.cumsum(np.where(z & 1, -(z + 1 >> 1), z >> 1))
            last = int(own[start + m - 1])
        v[c::components] = own
    return v.astype("<u2").tobytes() + tail
