"""Block codecs behind one registry, and the codec specification ``name:key=value:flag``."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CodecError(ValueError):
    pass


#: Codec ids as they are stored.
IDS = {"null": 0, "lzma": 1, "zstd": 2, "lz4": 3, "lz4hc": 4, "brotli": 5, "flac": 6, "ricepp": 7}
#: Codec, level and segmenting parameters of the presets 0 to 9 (block size bits, window size bits).
PRESETS = {0: ("null", 20, 0), 1: ("lz4", 20, 0), 2: ("lz4hc:level=9", 20, 0), 3: ("zstd:level=4", 21, 12), 4: ("zstd:level=11", 22, 12), 5: ("zstd:level=16", 23, 12), 6: ("zstd:level=20", 24, 12), 7: ("zstd:level=22", 24, 12), 8: ("lzma:level=8", 24, 12), 9: ("lzma:level=9", 26, 12)}


@dataclass(frozen=True)
class Spec:
    name: str
    options: tuple = ()

    def get(self, key: str, default=None):
        return dict(self.options).get(key, default)


#: Options that each codec takes.
OPTIONS = {"null": set(), "lz4": set(), "lz4hc": {"level"}, "zstd": {"level", "long"}, "lzma": {"level", "extreme"}, "brotli": {"quality"}, "ricepp": {"block_size", "components"}}


def parse(text: str) -> Spec:
    """A codec and its options; unknown codecs and options, and options given twice, are errors."""
    name, *parts = text.split(":")
    if name not in OPTIONS:
        raise CodecError(f"unknown codec: {name}")
    options: dict[str, str] = {}
    for part in parts:
        key, _, value = part.partition("=")
        if key in options:
            raise CodecError(f"option given twice: {key}")
        if key not in OPTIONS[name]:
            raise CodecError(f"unknown option for {name}: {key}")
        options[key] = value
    return Spec(name, tuple(options.items()))


def _arrow(name: str, level: int | None) -> tuple[Callable, Callable]:
    codec = pa.Codec(name, compression_level=level) if level is not None else pa.Codec(name)

    def pack(b: bytes) -> bytes:
        return struct.pack("<q", len(b)) + codec.compress(b, asbytes=True)

    def unpack(b: bytes) -> bytes:
        size = struct.unpack_from("<q", b)[0]
        return codec.decompress(b[8:], size, asbytes=True) if size else b""

    return pack, unpack


def _long(level: int) -> tuple[Callable, Callable]:
    """Zstandard that looks for matches at long distances."""
    import zstandard

    def pack(b: bytes) -> bytes:
        options = zstandard.ZstdCompressionParameters.from_level(level, enable_ldm=True, window_log=27)
        return zstandard.ZstdCompressor(compression_params=options).compress(b)

    return pack, lambda b: zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(b)


def functions(spec: Spec) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """Compress and decompress."""
    level = int(spec.get("level") or spec.get("quality") or 0) or None
    if spec.name == "null":
        return (lambda b: b), (lambda b: b)
    if spec.name in ("lz4", "lz4hc"):
        return _arrow("lz4_raw", (level or 9) if spec.name == "lz4hc" else None)
    if spec.name == "zstd" and spec.get("long") is not None:
        return _long(level or 3)
    if spec.name in ("zstd", "brotli"):
        return _arrow(spec.name, level)
    if spec.name == "lzma":
        preset = (level or 6) | (lzma.PRESET_EXTREME if spec.get("extreme") is not None else 0)
        return (lambda b: lzma.compress(b, preset=preset)), lzma.decompress
    if spec.name == "ricepp":
        from .rice import decode, encode

        size, parts = (int(spec.get(k) or v) for k, v in (("block_size", 128), ("components", 1)))
        return (lambda b: encode(b, size, parts)), decode
    raise CodecError(f"no library for {spec.name}")


def compressed(content: Column, spec: str) -> Column:
    """struct(codec, payload): compressed, or kept raw as codec ``null`` where that is not smaller."""
    parsed = parse(spec)

    @F.pandas_udf(T.StructType([T.StructField("codec", T.StringType()), T.StructField("payload", T.BinaryType())]))
    def pack(column: pd.Series) -> pd.DataFrame:
        do, _ = functions(parsed)
        rows = [(parsed.name, p) if len(p := do(b)) < len(b) else ("null", b) for b in (x or b"" for x in column)]
        return pd.DataFrame(rows, columns=["codec", "payload"])

    return pack(content)


def decompressed(block: Column, spec: str) -> Column:
    """The content of what ``compressed`` made with the same specification."""
    parsed = parse(spec)

    @F.pandas_udf(T.BinaryType())
    def unpack(block: pd.DataFrame) -> pd.Series:
        _, undo = functions(parsed)
        return pd.Series([p if c == "null" else undo(p) for c, p in zip(block["codec"], block["payload"], strict=True)], dtype=object)

    return unpack(block)


def pack_samples(values: np.ndarray, bits: int, size: int, big_endian: bool, signed: bool, padding_low: bool) -> bytes:
    """PCM samples of ``bits`` in ``size`` bytes, padded at the low or the high end."""
    v = values.astype(np.int64) + (0 if signed else 1 << bits - 1)
    if padding_low:
        v = v << (8 * size - bits)
    raw = (v & (1 << 8 * size) - 1).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return (raw[:, ::-1] if big_endian else raw).tobytes()


def unpack_samples(data: bytes, bits: int, size: int, big_endian: bool, signed: bool, padding_low: bool) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :size] = raw[:, ::-1] if big_endian else raw
    v = full.view("<u8")[:, 0].astype(np.int64)
    if padding_low:
        v >>= 8 * size - bits
    v &= (1 << bits) - 1
    if not signed:
        return v - (1 << bits - 1)
    return np.where(v >> bits - 1 & 1, v - (1 << bits), v)
