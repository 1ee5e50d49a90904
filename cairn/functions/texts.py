"""Text helpers that need more than the built-in functions: display width, simple case folding, path shortening."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def width_of(text: str) -> int:
    """Terminal columns: wide characters count two, combining and control characters none."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Me", "Mn") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def cut_to_width(text: str, most: int) -> str:
    out, used = [], 0
    for c in text:
        used += width_of(c)
        if used > most:
            break
        out.append(c)
    return "".join(out)


@F.pandas_udf(T.LongType())
def display_width(text: pd.Series) -> pd.Series:
    return text.map(lambda t: width_of(t or ""))


@F.pandas_udf(T.StringType())
def truncate_width(text: pd.Series) -> pd.Series:
    return text.map(lambda t: cut_to_width(t or "", 40))


def fold_char(c: str) -> str:
    """Simple case folding: one character to one."""
    folded = c.casefold()
    return folded if len(folded) == 1 else c.lower() if len(c.lower()) == 1 else c


@F.pandas_udf(T.StringType())
def simple_fold(text: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def fold(t):
        return "".join([known[c] if c in known else known.setdefault(c, fold_char(c)) for c in t])

    return text.map(lambda t: None if t is None else fold(t))


def shortened(path: str, most: int = 24, separator: str = "/") -> str:
    """A path of at most ``most`` columns.

    An ellipsis stands for the components that must go from the front; a last component that is too long still keeps
    its front, and a second ellipsis stands for its end.
    """
    if width_of(path) <= most:
        return path
    if most < 3:
        return ""
    tails = [path, *(path[k:] for k, c in enumerate(path) if k and c == separator)]
    short = "..." + next((t for t in tails if width_of(t) <= most - 3), tails[-1])
    if width_of(short) <= most:
        return short
    return cut_to_width(short, most - 3) + "..." if most >= 7 else "..."


@F.pandas_udf(T.StringType())
def shorten_path(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else shortened(p))
