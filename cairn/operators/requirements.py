"""Predicates generated from small specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class RequirementError(ValueError):
    pass


def satisfies(spec: dict[str, list], known: set[str]) -> Column:
    """AND of ``["set", [..]]`` and ``["range", low, high]`` over columns; an unknown key is an error, a column left out is free."""
    out = F.lit(True)
    for key, (kind, *args) in spec.items():
        if key not in known:
            raise RequirementError(f"unknown key: {key}")
        if kind == "set":
            out = out & F.col(key).isin(*args[0])
        elif kind == "range":
            low, high = args
            if low > high:
                raise RequirementError(f"empty range for {key}")
            out = out & F.col(key).between(low, high)
        else:
            raise RequirementError(f"unknown kind of requirement: {kind}")
    return out


def selected_categories(category: Column, spec: str) -> Column:
    """Membership in a comma-separated list; a leading ``!`` means all others."""
    names = [n for n in spec.removeprefix("!").split(",") if n]
    return ~category.isin(*names) if spec.startswith("!") else category.isin(*names)


def contextual(category: Column, options: dict[str, str], default: str) -> Column:
    """The option of a category, else the default."""
    out = F.lit(default)
    for name, value in options.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def parse_contextual(specs: list[str]) -> tuple[dict[str, str], str | None]:
    """``cat,cat::value`` and ``value`` items as (by category, default)."""
    by, default = {}, None
    for s in specs:
        names, mark, value = s.partition("::")
        if not mark:
            default = s
            continue
        for n in names.split(","):
            if n in by:
                raise RequirementError(f"two values for {n}")
            by[n] = value
    return by, default
