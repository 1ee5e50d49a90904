"""Globs as regular expressions, and ordered include/exclude rules over paths.

``*`` stays within a component (and needs a character if it is all of one), ``**`` crosses components,
``?`` is one character of a component, ``[..]`` a class (``!`` negates), ``{a,b}`` alternatives, a
backslash quotes.  The expressions use only what Java's and RE2's syntax have in common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(r".+^$|()[]{}*?\\")


class GlobError(ValueError):
    pass


def _class(glob: str, at: int) -> tuple[str, int]:
    """The regular expression of the class that opens at ``at``, and where it ends."""
    body, i = "", at + 1
    negated = glob[i : i + 1] == "!"
    i += negated
    first = i
    while i < len(glob):
        c = glob[i]
        if c == "]" and i > first:
            return f"[{'^' if negated else ''}{body}]", i + 1
        if c == "/":
            raise GlobError(f"'/' in a character class: {glob}")
        ranged = i + 2 < len(glob) and glob[i + 1] == "-" and glob[i + 2] != "]"
        if ranged:
            low, high = c, glob[i + 2]
            if low > high:
                raise GlobError(f"invalid range {low}-{high}: {glob}")
            parts = [(low, ".")] + [("0", high)] if low <= "/" <= high else [(low, high)]
            body += "".join(f"{_quoted(a)}-{_quoted(b)}" for a, b in parts if a <= b)
            i += 3
        else:
            body += _quoted(c)
            i += 1
    raise GlobError(f"unmatched '[': {glob}")


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL or c == "-" else c


def regex_of(glob: str) -> str:
    """The body of the regular expression; anchor it with ``anchored``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        whole_start = i == 0 or glob[i - 1] == "/"
        if c == "\\":
            if i + 1 == len(glob):
                raise GlobError(f"trailing backslash: {glob}")
            out, i = out + _quoted(glob[i + 1]), i + 2
        elif glob.startswith("**", i):
            i += 3 if whole_start and glob[i + 2 : i + 3] == "/" else 2
            out += ".*"
        elif c == "*":
            alone = whole_start and glob[i + 1 : i + 2] in ("", "/")
            out, i = out + ("[^/]+" if alone else "[^/]*"), i + 1
        elif c == "[":
            body, i = _class(glob, i)
            out += body
        else:
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            if depth < 0 or c == "]":
                raise GlobError(f"unmatched '{c}': {glob}")
            out += {"?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else ")" if c == "}" else _quoted(c))
            i += 1
    if depth:
        raise GlobError(f"unmatched '{{': {glob}")
    return out


def anchored(glob: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + f"^(?:{regex_of(glob)})$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; a glob after ``i:`` ignores case, one after ``:`` is taken as it is."""
    found = F.lit(False)
    for g in globs:
        ignore = g.startswith("i:")
        g = g[2:] if ignore else g.removeprefix(":")
        found = found | path.rlike(anchored(g, ignore))
    return found


@dataclass(frozen=True)
class Rule:
    keep: bool
    pattern: str


def parse_rules(text: str, read=None) -> list[Rule]:
    """Rules, one a line: ``+ glob``, ``- glob``, with ``i`` after the sign to ignore case, ``. name`` for a merge file.

    ``read`` gives the text of a merge file; a file that includes itself is an error.
    """
    out: list[Rule] = []

    def add(text: str, inside: tuple) -> None:
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            sign, _, glob = line.partition(" ")
            glob = glob.strip()
            if sign == ".":
                if glob in inside:
                    raise GlobError(f"recursion in merge file {glob}")
                if read is None:
                    raise GlobError(f"no reader for merge file {glob}")
                add(read(glob), (*inside, glob))
            elif sign[:1] in "+-" and sign[1:] in ("", "i") and glob:
                floating = not glob.startswith("/")
                body = ("^(?:.*/)?" if floating else "^") + f"(?:{regex_of(glob)})$"
                out.append(Rule(sign[0] == "+", ("(?i)" if sign[1:] else "") + body))
            else:
                raise GlobError(f"cannot parse rule: {line}")

    add(text, ())
    return out


def kept_by(path: Column, rules: list[Rule]) -> Column:
    """The first rule that matches decides; without one a path is kept."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(path.rlike(r.pattern), F.lit(r.keep)).otherwise(out)
    return out
