"""Recognisers of binary formats: audio containers, FITS images, executables, image sections.

Each gives the fragments of a content as (category, subcategory, length); their lengths add up to it.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAGMENTS = T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("sub", T.StringType()), T.StructField("length", T.LongType())]))
#: Names of machines in executable headers.
ELF_MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "aarch64", 243: "riscv", 8: "mips", 21: "ppc64", 22: "s390"}
PE_MACHINES = {0x14C: "x86", 0x8664: "x86_64", 0x1C0: "arm", 0xAA64: "aarch64"}
MACHO_MACHINES = {7: "x86", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "aarch64"}
_CODEC = pa.Codec("zstd", compression_level=-1)


def _rest(parts: list[tuple[str, str | None, int]], size: int):
    used = sum(p[2] for p in parts)
    return [p for p in [*parts, ("default", None, size - used)] if p[2] > 0]


def incompressible(data: bytes, block: int = 1 << 20, least: int = 256, ratio: float = 0.99, whole: bool = False):
    """Runs of blocks that hardly shrink, or all if it hardly shrinks as a ``whole``; nothing if all is compressible or small."""
    if len(data) < least:
        return []
    if whole:
        packed = sum(len(_CODEC.compress(data[at : at + block], asbytes=True)) for at in range(0, len(data), block))
        return [("incompressible", None, len(data))] if packed >= ratio * len(data) else []
    runs: list[list] = []
    for at in range(0, len(data), block):
        part = data[at : at + block]
        kind = "incompressible" if len(_CODEC.compress(part, asbytes=True)) >= ratio * len(part) else "default"
        if runs and runs[-1][0] == kind:
            runs[-1][2] += len(part)
        else:
            runs.append([kind, None, len(part)])
    return [] if len(runs) == 1 and runs[0][0] == "default" else [tuple(r) for r in runs]


def _samples(endian: str, signed: bool, pad: str, bits: int, size: int, channels: int) -> str | None:
    """The subcategory, if the numbers make sense."""
    if not (1 <= channels <= 255 and 8 <= bits <= 32 and 1 <= size <= 4 and bits <= 8 * size):
        return None
    return f"{endian}-endian {'signed' if signed else 'unsigned'} {bits} bits in {size} bytes, {pad} padding, {channels} channels"


def _audio(data: bytes, start: int, length: int, sub: str | None, frame: int):
    length = min(length, len(data) - start)
    length -= length % frame if frame else 0
    if sub is None or length <= 0:
        return []
    return _rest([("metadata", None, start), ("waveform", sub, length)], len(data))


def wav(data: bytes):
    """RIFF/WAVE and its 64-bit form with 16-byte chunk names."""
    wide = data[:4] == b"riff" and len(data) >= 40 and data[24:28] == b"wave"
    if not wide and not (data[:4] == b"RIFF" and data[8:12] == b"WAVE"):
        return []
    at, sub, frame = (40 if wide else 12), None, 0
    head = 24 if wide else 8
    while at + head <= len(data):
        name = data[at : at + 4]
        size = struct.unpack_from("<q" if wide else "<I", data, at + (16 if wide else 4))[0] - (24 if wide else 0)
        body = at + head
        if size < 0:
            return []
        if name == b"fmt " and size >= 16 and body + 16 <= len(data):
            code, channels, _, _, frame, bits = struct.unpack_from("<HHIIHH", data, body)
            size_of = frame // channels if channels and frame % max(channels, 1) == 0 else 0
            sub = _samples("little", bits > 8, "lsb", bits, size_of, channels) if code in (1, 0xFFFE) else None
        elif name == b"data":
            return _audio(data, body, size, sub, frame)
        at = body + size + (-size % 8 if wide else size & 1)
    return []


def _extended(raw: bytes) -> float:
    exponent, mantissa = struct.unpack(">HQ", raw)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446)


def aiff(data: bytes):
    if data[:4] != b"FORM" or data[8:12] != b"AIFF":
        return []
    at, sub, frame = 12, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        if name == b"COMM" and size >= 18 and at + 26 <= len(data):
            channels, _, bits = struct.unpack_from(">HIH", data, at + 8)
            if not _extended(data[at + 16 : at + 26]) > 0:
                return []
            width = (bits + 7) // 8
            sub, frame = _samples("big", True, "lsb", bits, width, channels), channels * width
        elif name == b"SSND" and at + 16 <= len(data):
            offset = struct.unpack_from(">I", data, at + 8)[0]
            return _audio(data, at + 16 + offset, size - 8 - offset, sub, frame)
        at += 8 + size + (size & 1)
    return []


def caf(data: bytes):
    if data[:4] != b"caff" or len(data) < 8:
        return []
    at, sub, frame = 8, None, 0
    while at + 12 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(">q", data, at + 4)[0]
        if name == b"desc" and at + 44 <= len(data):
            _, form, flags, packet, per, channels, bits = struct.unpack_from(">d4sIIIII", data, at + 12)
            width = packet // channels if channels and per == 1 else 0
            good = form == b"lpcm" and not flags & 1
            sub, frame = (_samples("little" if flags & 2 else "big", True, "msb", bits, width, channels) if good else None), packet
        elif name == b"data":
            length = len(data) - at - 16 if size == -1 else size - 4
            return _audio(data, at + 16, length, sub, frame)
        if size < 0:
            return []
        at += 12 + size
    return []


def fits(data: bytes):
    """Two-dimensional 16-bit images: header of 80-column cards in frames of 2880 bytes, then big-endian samples."""
    cards: dict[str, str] = {}
    for at in range(0, len(data) - 79, 80):
        card = data[at : at + 80].decode("latin-1")
        key = card[:8].strip()
        if key == "END":
            break
        if card[8:10] == "= ":
            cards[key] = card[10:].split("/")[0].strip()
    else:
        return []
    if cards.get("SIMPLE") != "T" or cards.get("BITPIX") != "16" or cards.get("NAXIS") != "2":
        return []
    try:
        pixels = int(cards["NAXIS1"]) * int(cards["NAXIS2"])
    except (KeyError, ValueError):
        return []
    start = -(-(at + 80) // 2880) * 2880
    if pixels <= 0 or start + 2 * pixels > len(data):
        return []
    folded = 0
    for k in range(start, start + 2 * pixels, 2):
        folded |= data[k] << 8 | data[k + 1]
    unused = (folded & -folded).bit_length() - 1 if folded else 16
    components = 2 if "BAYERPAT" in cards else 1
    return _rest([("metadata", None, start), ("image", f"{components} components, {unused} unused bits", 2 * pixels)], len(data))


def executable(data: bytes):
    """ELF, PE and Mach-O as a whole; universal Mach-O by its parts."""
    if data[:4] == b"\x7fELF" and len(data) >= 20:
        order = "<" if data[5] == 1 else ">"
        return [("binary/elf", f"{ELF_MACHINES.get(struct.unpack_from(order + 'H', data, 18)[0], 'other')} {'little' if order == '<' else 'big'}", len(data))]
    if data[:2] == b"MZ" and len(data) >= 64:
        at = struct.unpack_from("<I", data, 60)[0]
        if data[at : at + 4] == b"PE\0\0" and at + 6 <= len(data):
            return [("binary/pe", PE_MACHINES.get(struct.unpack_from("<H", data, at + 4)[0], "other"), len(data))]
    magic = data[:4]
    if magic in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf") and len(data) >= 8:
        order = "<" if magic[0] in (0xCE, 0xCF) else ">"
        return [("binary/macho", MACHO_MACHINES.get(struct.unpack_from(order + "I", data, 4)[0], "other"), len(data))]
    if magic == b"\xca\xfe\xba\xbe" and len(data) >= 8:
        count = struct.unpack_from(">I", data, 4)[0]
        if 0 < count < 32 and 8 + 20 * count <= len(data):
            parts = sorted((struct.unpack_from(">IIIII", data, 8 + 20 * k) for k in range(count)), key=lambda p: p[2])
            out, at = [], 0
            for machine, _, offset, size, _ in parts:
                if offset < at or offset + size > len(data):
                    return []
                out += [("default", None, offset - at)] * (offset > at) + [("binary/macho", MACHO_MACHINES.get(machine, "other"), size)]
                at = offset + size
            return _rest(out, len(data))
    return []


#: Categorizers by name, and whether each looks at any place of a content (random access) or reads it through.
REGISTRY = {"pcmaudio": lambda b: wav(b) or aiff(b) or caf(b), "fits": fits, "binary": executable, "incompressible": incompressible}
SEQUENTIAL = {"incompressible"}


def categorize(data: bytes, order: list[str], **options) -> list[tuple[str, str | None, int]]:
    """Fragments of the first categorizer in order that knows the content.

    Random-access ones are asked first, and sequential ones (with ``options``) only if listed before the one that answered.
    """
    answer, at = [], len(order)
    for k, name in enumerate(order):
        if name not in SEQUENTIAL and (answer := REGISTRY[name](data)):
            at = k
            break
    for name in order[:at]:
        if name in SEQUENTIAL and (found := REGISTRY[name](data, **options)):
            return found
    return answer or ([("default", None, len(data))] if data else [])


def categorized(order: list[str], **options):
    @F.pandas_udf(FRAGMENTS)
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: [{"category": c, "sub": s, "length": n} for c, s, n in categorize(b or b"", order, **options)])

    return run


#: Fixed value: mark at the start of a section of our own container.
MAGIC = b"CAIRN\x01"


def section(number: int, kind: int, payload: bytes) -> bytes:
    """Header (mark, number, kind, length, checksum of what follows the mark) and payload."""
    tail = struct.pack("<IHQ", number, kind, len(payload))
    return MAGIC + struct.pack("<I", zlib.crc32(tail + payload)) + tail + payload


HEADER = len(MAGIC) + 4 + 14


def find_container(data: bytes) -> int:
    """Where sections begin: the first mark whose section is whole and whose next header, if any, is one; -1 if none."""
    at = data.find(MAGIC)
    while at >= 0:
        if (end := _section_end(data, at)) >= 0 and (end == len(data) or data.startswith(MAGIC, end)):
            return at
        at = data.find(MAGIC, at + 1)
    return -1


def _section_end(data: bytes, at: int) -> int:
    if at + HEADER > len(data):
        return -1
    crc, _, _, length = struct.unpack_from("<IIHQ", data, at + len(MAGIC))
    end = at + HEADER + length
    return end if end <= len(data) and zlib.crc32(data[at + len(MAGIC) + 4 : end]) == crc else -1


def read_sections(data: bytes) -> list[tuple[int, int, bytes]]:
    out, at = [], find_container(data)
    while 0 <= at < len(data) and (end := _section_end(data, at)) >= 0:
        _, number, kind, _ = struct.unpack_from("<IIHQ", data, at + len(MAGIC))
        out.append((number, kind, data[at + HEADER : end]))
        at = end
    return out
