"""File modes as bit expressions: permission strings, access checks and chmod specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permission and set-id bits, and the bits that each class of users owns.
READ, WRITE, EXEC, SET_ID, STICKY, ALL = 0o444, 0o222, 0o111, 0o6000, 0o1000, 0o7777
OWNED = {"u": 0o4700, "g": 0o2070, "o": 0o1007, "a": ALL}
SHIFT = {"u": 6, "g": 3, "o": 0}
GRANTED = {"r": READ, "w": WRITE, "x": EXEC, "s": SET_ID, "t": STICKY}


def permission_string(mode: Column) -> Column:
    """rwxrwxrwx with s, S, t and T for the special bits."""
    parts = []
    for k in range(9):
        bit, plain = 0o400 >> k, "rwx"[k % 3]
        on = mode.bitwiseAND(F.lit(bit)) != 0
        if plain == "x":
            special = mode.bitwiseAND(F.lit((0o4000, 0o2000, 0o1000)[k // 3])) != 0
            low = "t" if k == 8 else "s"
            parts.append(F.when(special & on, low).when(special, low.upper()).when(on, "x").otherwise("-"))
        else:
            parts.append(F.when(on, plain).otherwise("-"))
    return F.concat(*parts)


def type_letter(mode: Column) -> Column:
    out = F.lit("?")
    for bits, letter in ((0o140000, "s"), (0o120000, "l"), (0o100000, "-"), (0o060000, "b"), (0o040000, "d"), (0o020000, "c"), (0o010000, "p")):
        out = F.when(mode.bitwiseAND(F.lit(0o170000)) == bits, letter).otherwise(out)
    return out


def may_access(mode: Column, owner: Column, group: Column, want: int, uid: int, gid: int) -> Column:
    """Whether a user may access a file: root reads and writes all and executes what anyone may; others have the bits of every class they are in."""
    if uid == 0:
        granted = F.when(mode.bitwiseAND(F.lit(EXEC)) != 0, F.lit(7)).otherwise(F.lit(6))
    else:
        granted = mode.bitwiseAND(F.lit(7))
        granted = granted.bitwiseOR(F.when(group == gid, F.shiftright(mode, 3).bitwiseAND(F.lit(7))).otherwise(F.lit(0)))
        granted = granted.bitwiseOR(F.when(owner == uid, F.shiftright(mode, 6).bitwiseAND(F.lit(7))).otherwise(F.lit(0)))
    return granted.bitwiseAND(F.lit(want)) == want


@dataclass(frozen=True)
class Change:
    op: str
    who: int  # bits owned by the classes named; 0: none named
    bits: int
    copy: str = ""  # class whose permissions are copied
    executable: bool = False  # X: execute bits for directories and for what is executable already
    octal: bool = False


class ChmodError(ValueError):
    pass


def parse_chmod(spec: str) -> tuple[list[Change], set[str]]:
    """The changes of one clause, and which of D (directories) and F (files) it is restricted to."""
    if not spec:
        raise ChmodError("empty mode")
    if spec[0] in "01234567":
        if not all(c in "01234567" for c in spec) or int(spec, 8) > ALL:
            raise ChmodError(f"invalid octal mode: {spec}")
        return [Change("=", 0, int(spec, 8), octal=True)], set()
    who, only, i = 0, set(), 0
    while i < len(spec) and spec[i] not in "=+-":
        if spec[i] in OWNED:
            who |= OWNED[spec[i]]
        elif spec[i] in "DF":
            only.add(spec[i])
        i += 1
    if i == len(spec):
        raise ChmodError(f"no operation in mode: {spec}")
    changes = []
    while i < len(spec) and spec[i] in "=+-":
        op, i = spec[i], i + 1
        digits = len(spec[i:]) - len(spec[i:].lstrip("01234567"))
        if i == len(spec):
            raise ChmodError(f"no permissions in mode: {spec}")
        if digits:
            if who or i + digits < len(spec) or int(spec[i:], 8) > ALL:
                raise ChmodError(f"invalid octal permissions: {spec}")
            changes.append(Change(op, 0, int(spec[i:], 8), octal=True))
            i = len(spec)
        elif spec[i] in SHIFT:
            changes.append(Change(op, who, 0, copy=spec[i]))
            i += 1
        else:
            end = i
            while end < len(spec) and spec[end] in "rwxstX":
                end += 1
            bits = 0
            for c in spec[i:end].replace("X", ""):
                bits |= GRANTED[c]
            changes.append(Change(op, who, bits, executable="X" in spec[i:end]))
            i = end
    if i < len(spec):
        raise ChmodError(f"trailing characters in mode: {spec}")
    return changes, only


def chmod(mode: Column, is_dir: Column, spec: str, umask: int = 0o022) -> Column:
    """The mode after a comma-separated chmod specification, as one bit expression."""
    for clause in spec.split(","):
        changes, only = parse_chmod(clause)
        new = mode
        for c in changes:
            new = _applied(new, is_dir, c, umask)
        if only:
            applies = (F.lit("D" in only) & is_dir) | (F.lit("F" in only) & ~is_dir)
            new = F.when(applies, new).otherwise(mode)
        mode = new
    return mode


def _applied(mode: Column, is_dir: Column, c: Change, umask: int) -> Column:
    # directories keep their set-id bits unless the change names them
    named = SET_ID if c.octal and c.op != "=" else c.bits & (c.who or ALL) & SET_ID
    spared = F.when(is_dir, F.lit(SET_ID & ~named)).otherwise(F.lit(0))
    reach = ALL if c.octal else c.who or (ALL & ~umask)
    value = F.lit(c.bits)
    if c.copy:
        three = F.shiftright(mode, SHIFT[c.copy]).bitwiseAND(F.lit(7))
        value = three.bitwiseOR(F.shiftleft(three, 3)).bitwiseOR(F.shiftleft(three, 6))
    if c.executable:
        value = value.bitwiseOR(F.when(is_dir | (mode.bitwiseAND(F.lit(EXEC)) != 0), F.lit(EXEC)).otherwise(F.lit(0)))
    value = value.bitwiseAND(F.lit(reach)).bitwiseAND(F.bitwise_not(spared))
    if c.op == "+":
        return mode.bitwiseOR(value)
    if c.op == "-":
        return mode.bitwiseAND(F.bitwise_not(value))
    outside = F.lit(ALL & ~(ALL if c.octal else c.who or ALL)).bitwiseOR(spared)
    return mode.bitwiseAND(outside).bitwiseOR(value)
