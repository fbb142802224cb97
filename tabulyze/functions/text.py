"""Scalar display and parsing functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Texts the reference's readers take as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Symbols that mark currency text.
CURRENCY_SYMBOLS = "$€£¥"
# What is dropped from currency text: symbols, commas and white space of any kind.
CURRENCY_NOISE = CURRENCY_SYMBOLS + "," + "".join(
    chr(i) for i in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# Date layouts that are tried, month before day; list order decides ties. Length and
# shape are cheap tests in front of the parser, whose failures are slow.
DATE_LAYOUTS = {
    "yyyy-MM-dd": (10, 10, r"^\d{4}-\d{2}-\d{2}$"),
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]":
        (19, 26, r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"),
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]":
        (19, 26, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"),
    "M/d/yyyy": (8, 10, r"^\d{1,2}/\d{1,2}/\d{4}$"),
    "M/d/yyyy H:mm": (13, 16, r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
}
DATE_PATTERNS = tuple(DATE_LAYOUTS)

_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_INTEGRAL_TYPES = ("tinyint", "smallint", "int", "bigint")


def _no_nan(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _named_infinity(c: Column, text: Column) -> Column:
    d = c.cast("double")
    return (
        F.when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(text)
    )


def fmt_number(c: Column, decimals: int = 2) -> Column:
    """Thousands separators; whole-number types carry no decimals; NULL gives N/A."""
    whole = F.typeof(c).isin(*_INTEGRAL_TYPES)
    fraction = _named_infinity(c, F.format_number(_no_nan(c), decimals))
    return F.coalesce(F.when(whole, F.format_number(c, 0)).otherwise(fraction), F.lit("N/A"))


def fmt_percentage(c: Column, decimals: int = 2) -> Column:
    """A share as percent text: 0.456 gives 45.60%; NULL gives N/A."""
    pattern = "0." + "0" * decimals if decimals else "0"
    text = F.call_function("format_number", _no_nan(c) * F.lit(100.0), F.lit(pattern))
    return F.coalesce(F.concat(_named_infinity(c, text), F.lit("%")), F.lit("N/A"))


def safe_divide(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or `default` where den is 0 or missing."""
    d = _no_nan(den)
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(
        F.try_divide(num.cast("double"), d)
    )


def truncate_text(c: Column, max_length: int = 50, suffix: str = "...") -> Column:
    """Cut to `max_length` characters, the suffix counted in."""
    room = max_length - len(suffix)
    if room >= 0:
        kept = F.substring(c, 1, room)
    else:
        kept = F.substring(c, F.lit(1), F.greatest(F.length(c) + room, F.lit(0)))
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(kept, F.lit(suffix)))


def na_to_null(c: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def parse_number(c: Column) -> Column:
    """Text as double; anything that is not a plain number becomes NULL."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def parse_integer(c: Column, dtype: str = "bigint") -> Column:
    return F.when(c.rlike(_INTEGER), c.try_cast(dtype))


def is_whole(c: Column) -> Column:
    """Text that is a whole number of any length."""
    return c.rlike(_INTEGER)


def _iso(c: Column, pattern: str) -> Column:
    """Text of a listed layout in the form that a cast reads, without going by a time zone."""
    if not pattern.startswith("M/d/yyyy"):
        return c
    day = F.regexp_replace(c, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    return F.concat(day, F.lit(":00")) if "H:mm" in pattern else day


def parse_timestamp(c: Column, pattern: str | None = None) -> Column:
    """Text as a zone-less timestamp; unparsable text becomes NULL.

    Without a pattern each value takes the first layout of DATE_PATTERNS that fits. Listed layouts
    are read as they stand, whatever the session's zone; others go by Spark's parser.
    """
    patterns = (pattern,) if pattern else DATE_PATTERNS
    tried = []
    for p in patterns:
        if p in DATE_LAYOUTS:
            shortest, longest, shape = DATE_LAYOUTS[p]
            fits = F.length(c).between(shortest, longest) & c.rlike(shape)
            tried.append(F.when(fits, _iso(c, p).try_cast("timestamp_ntz")))
        else:
            tried.append(F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz"))
    return tried[0] if len(tried) == 1 else F.coalesce(*tried)


def clean_currency(c: Column) -> Column:
    """Currency text as double: symbols, commas and spaces are dropped first."""
    return parse_number(F.translate(c, CURRENCY_NOISE, ""))


def has_currency_symbol(c: Column) -> Column:
    return reduce(or_, [c.contains(symbol) for symbol in CURRENCY_SYMBOLS])
