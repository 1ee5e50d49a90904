"""Sizes, times and ratios as text and back, as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Binary units, and time suffixes with their nanoseconds.
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
TIME_UNITS = {
    "ns": 1, "nsec": 1, "us": 10**3, "usec": 10**3, "ms": 10**6, "msec": 10**6, "s": 10**9, "sec": 10**9,
    "m": 60 * 10**9, "min": 60 * 10**9, "h": 3600 * 10**9, "hour": 3600 * 10**9, "d": 86400 * 10**9, "day": 86400 * 10**9,
}
TIME_POINTS = ["yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm", "yyyyMMdd'T'", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyyMMdd"]


def magnitude(size: Column) -> Column:
    """Number of the binary unit: bits of the size, in tens."""
    return F.floor((F.length(F.bin(size.bitwiseOR(F.lit(1)))) - 1) / 10).cast("int")


def size_with_unit(size: Column) -> Column:
    """A size with four significant digits and a binary unit; trailing zeros are dropped."""
    k = magnitude(size)
    value = size / F.pow(F.lit(2.0), 10 * k)
    # digits before the point: 1 to 4, so 3 to 0 after it
    whole = F.floor(value)
    places = F.when(whole >= 1000, 0).when(whole >= 100, 1).when(whole >= 10, 2).otherwise(3)
    text = F.lit(None)
    for p in range(4):
        text = F.when(places == p, F.format_string(f"%.{p}f", F.bround(value, p))).otherwise(text)
    trimmed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.concat(trimmed, F.lit(" "), F.element_at(F.array(*map(F.lit, SIZE_UNITS)), k + 1))


def parse_size(text: Column) -> Column:
    """Digits and an optional k, m, g or t (powers of 1024); anything else is null."""
    digits = F.regexp_extract(text, "^([0-9]+)([kKmMgGtT]?)$", 1)
    unit = F.lower(F.regexp_extract(text, "^([0-9]+)([kKmMgGtT]?)$", 2))
    factor = F.when(unit == "", 1).when(unit == "k", 2**10).when(unit == "m", 2**20).when(unit == "g", 2**30).when(unit == "t", 2**40)
    return F.when(digits != "", digits.try_cast("long") * factor.cast("long"))


def parse_time(text: Column) -> Column:
    """Nanoseconds of a number with a unit; a bare unit counts once, a bare number is seconds, anything else null."""
    pattern = "^([0-9]*) ?([a-z]*)$"
    digits, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    scale = F.create_map(*(F.lit(x) for k, v in TIME_UNITS.items() for x in (k, v)))
    factor = F.when(unit == "", F.lit(10**9)).otherwise(F.try_element_at(scale, unit))
    number = F.when((digits == "") & (unit != ""), F.lit(1)).otherwise(F.expr("1") * digits.try_cast("long"))
    return number.cast("long") * factor.cast("long")


def parse_time_point(text: Column) -> Column:
    """The first of the fixed formats that matches the whole text, as a timestamp without zone; else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_POINTS)).cast("timestamp_ntz")


def time_with_unit(ns: Column) -> Column:
    """Under a minute: one unit and four significant digits, cut off; above: four digits over days, hours, minutes, seconds."""

    def cut(value: Column, scale: int, places: Column, suffix: str) -> Column:
        whole = (value - value % F.lit(scale)) / F.lit(scale)
        out = None
        for p in range(4):
            scaled = (value % F.lit(scale)) * F.lit(10**p)
            part = ((scaled - scaled % F.lit(scale)) / F.lit(scale)).cast("long")
            text = whole.cast("long").cast("string")
            if p:
                text = F.when(part > 0, F.concat(text, F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), p, "0"), "0+$", ""))).otherwise(text)
            out = F.when(places == p, text) if out is None else out.when(places == p, text)
        return F.concat(out, F.lit(suffix))

    short = F.lit("0s")
    for scale, suffix in ((1, "ns"), (10**3, "us"), (10**6, "ms"), (10**9, "s")):
        whole = (ns - ns % scale) / scale
        places = F.when(whole >= 1000, 0).when(whole >= 100, 1).when(whole >= 10, 2).otherwise(3) if scale > 1 else F.lit(0)
        short = F.when(ns >= scale, cut(ns, scale, places, suffix)).otherwise(short)
    days, hours, minutes = (F.floor(ns / F.lit(86400 * 10**9)), F.floor(ns % F.lit(86400 * 10**9) / F.lit(3600 * 10**9)), F.floor(ns % F.lit(3600 * 10**9) / F.lit(60 * 10**9)))
    rest = ns % F.lit(60 * 10**9)
    left_h = F.when(days > 0, 4 - F.length(days.cast("string"))).otherwise(F.lit(4))
    left_m = F.when(days > 0, left_h - 2).when(hours > 0, 4 - F.length(hours.cast("string"))).otherwise(F.lit(4))
    left_s = F.when((days > 0) | (hours > 0), left_m - 2).otherwise(4 - F.length(minutes.cast("string")))
    seconds = cut(rest, 10**9, F.greatest(left_s - 2, F.lit(0)), "s")
    long = F.concat_ws(
        " ", F.when(days > 0, F.concat(days.cast("string"), F.lit("d"))), F.when((hours > 0) & (left_h > 0), F.concat(hours.cast("string"), F.lit("h"))),
        F.when((minutes > 0) & (left_m > 0), F.concat(minutes.cast("string"), F.lit("m"))), F.when((left_s > 0) & (seconds != "0s"), seconds),
    )
    return F.when(ns < 60 * 10**9, short).otherwise(long)


def ratio_text(num: int, den: int, precision: int = 3) -> str:
    """A ratio as %, ppm, ppb or a factor, with exact half-up rounding."""
    if den == 0:
        return "N/A"
    if num == 0:
        return "0x"
    with localcontext() as c:
        c.prec = 60
        exact = Decimal(num) / Decimal(den)

    def rounded(x: Decimal) -> Decimal:
        with localcontext() as c:
            c.prec, c.rounding = precision, ROUND_HALF_UP
            return +x

    def fixed(x: Decimal) -> str:
        text = f"{x:f}"
        return text.rstrip("0").rstrip(".") if "." in text else text

    for shift, low, high, unit in ((2, Decimal("0.1"), 100, "%"), (6, 1, 1000, "ppm"), (9, 1, 1000, "ppb")):
        if low <= (scaled := rounded(exact.scaleb(shift))) < high:
            return fixed(scaled) + unit
    plain = rounded(exact)
    if plain < Decimal("0.001"):
        digits, exponent = f"{plain:e}".split("e") if "e" in f"{plain:e}" else (f"{plain:e}", "0")
        return f"{fixed(Decimal(digits))}e{int(exponent):+03d}x"
    return fixed(plain) + "x"


@F.pandas_udf(T.StringType())
def ratio_to_string(num: pd.Series, den: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else ratio_text(int(a), int(b)) for a, b in zip(num, den, strict=True)], dtype=object)


def to_bool(text: Column) -> Column:
    """Truth words in any case: 1 t y true yes on; 0 f n false no off; anything else null."""
    low = F.lower(text)
    return F.when(low.isin("1", "t", "y", "true", "yes", "on"), True).when(low.isin("0", "f", "n", "false", "no", "off"), False)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def bit_width(value: Column) -> Column:
    """Bits that a non-negative number needs; none for zero."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("int")
