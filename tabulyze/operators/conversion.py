"""Type detection and conversion of text columns.

Detection is one aggregate job whose single result row becomes a plan, `{column: step}`.
Steps are casts. Pass a known plan in to skip the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import CATEGORICAL, col, column_types
from tabulyze.functions.text import (
    DATE_PATTERNS, clean_currency, has_currency_symbol, na_to_null,
    is_whole, parse_integer, parse_number, parse_timestamp,
)

# The type of whole numbers beyond 64 bits.
WIDE = "decimal(38,0)"

# Texts read as truth values, upper case.
TRUE_TEXTS = ("TRUE", "YES", "1")
FALSE_TEXTS = ("FALSE", "NO", "0")

CURRENCY_ONE_IN = 10
DATE_SHARE = 0.5


@dataclass(frozen=True)
class Step:
    """What to do with a column: kind is date, currency, boolean, integer or number."""

    kind: str
    pattern: str | None = None

    def apply(self, c: Column) -> Column:
        if self.kind == "date":
            return parse_timestamp(c, self.pattern)
        if self.kind == "currency":
            return clean_currency(c)
        if self.kind == "boolean":
            return to_boolean(c)
        if self.kind == "integer":
            return parse_integer(c)
        if self.kind == "wide":
            return parse_integer(c, WIDE)
        return parse_number(c)


Plan = dict[str, Step]


def to_boolean(c: Column) -> Column:
    """TRUE, YES, 1 and FALSE, NO, 0 in any case; other text becomes NULL."""
    upper = F.upper(c)
    return F.when(upper.isin(*TRUE_TEXTS), True).when(upper.isin(*FALSE_TEXTS), False)


def apply_plan(df: DataFrame, plan: Plan) -> DataFrame:
    if not plan:
        return df
    return df.withColumns({name: step.apply(col(name)) for name, step in plan.items()})


def _text(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = column_types(df)[CATEGORICAL]
    return names if columns is None else [n for n in names if n in set(columns)]


def _date_asks(i: int, c: Column) -> list[Column]:
    return [
        F.count(parse_timestamp(c, p)).alias(f"d{i}_{j}") for j, p in enumerate(DATE_PATTERNS)
    ]


def _best_date(row, i: int) -> str | None:
    hits = [row[f"d{i}_{j}"] for j in range(len(DATE_PATTERNS))]
    best = max(range(len(hits)), key=lambda j: (hits[j], -j))
    present = row[f"n{i}"]
    return DATE_PATTERNS[best] if present and hits[best] / present > DATE_SHARE else None


def detect_dates(df: DataFrame, columns: Sequence[str] | None = None) -> Plan:
    """Text columns where more than half of all values fit one date layout."""
    names = _text(df, columns)
    if not names:
        return {}
    asks = []
    for i, n in enumerate(names):
        asks += [F.count(col(n)).alias(f"n{i}"), *_date_asks(i, col(n))]
    row = df.agg(*asks).first()
    found = {n: _best_date(row, i) for i, n in enumerate(names)}
    return {n: Step("date", p) for n, p in found.items() if p}


def _currency_asks(i: int, c: Column) -> list[Column]:
    return [
        F.count_if(has_currency_symbol(c)).alias(f"s{i}"),
        F.count(clean_currency(c)).alias(f"m{i}"),
    ]


def _is_currency(row, i: int) -> bool:
    present = row[f"n{i}"]
    return (
        present > 0
        and row[f"s{i}"] * CURRENCY_ONE_IN >= present
        and row[f"m{i}"] * 2 > present
    )


def detect_currency(df: DataFrame, columns: Sequence[str] | None = None) -> Plan:
    """Text columns where one value in ten has a currency symbol and most are amounts.

    The second condition keeps prose that mentions a price from being wiped.
    """
    names = _text(df, columns)
    if not names:
        return {}
    asks = []
    for i, n in enumerate(names):
        asks += [F.count(col(n)).alias(f"n{i}"), *_currency_asks(i, col(n))]
    row = df.agg(*asks).first()
    return {
        n: Step("currency")
        for i, n in enumerate(names)
        if _is_currency(row, i)
    }


def _spelling(c: Column) -> Column:
    """A bit of its own for each spelling, upper or lower case, of a truth word; else NULL."""
    word, start = F.upper(c), F.lit(None).cast("int")
    first = 0
    for text in (*TRUE_TEXTS, *FALSE_TEXTS):
        start = F.when(word == text, F.lit(first)).otherwise(start)
        first += 1 << sum(map(str.isalpha, text))
    case = reduce(add, [
        F.when(F.substring(c, i + 1, 1).between("A", "Z"), F.lit(1 << i)).otherwise(F.lit(0))
        for i in range(max(map(len, FALSE_TEXTS)))
    ])
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.call_function("shiftleft", F.lit(1).cast("bigint"), start + case))


def _boolean_asks(i: int, c: Column) -> list[Column]:
    bit = _spelling(c)
    spellings = F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")))
    return [F.count(bit).alias(f"k{i}"), spellings.alias(f"u{i}")]


def detect_booleans(df: DataFrame, columns: Sequence[str] | None = None) -> Plan:
    """Text columns made of at most two distinct truth words."""
    names = _text(df, columns)
    if not names:
        return {}
    asks = []
    for i, n in enumerate(names):
        asks += [F.count(col(n)).alias(f"n{i}"), *_boolean_asks(i, col(n))]
    row = df.agg(*asks).first()
    return {
        n: Step("boolean")
        for i, n in enumerate(names)
        if row[f"n{i}"] and row[f"k{i}"] == row[f"n{i}"] and row[f"u{i}"] <= 2
    }


def detect_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> Plan:
    """Text columns that are whole numbers or numbers throughout, as a reader types them."""
    return _detected(df, _text(df, columns), numbers=True)


def detect_types(df: DataFrame) -> Plan:
    """Dates, then currency, then booleans, each column taking the first that fits.

    One job over all text columns.
    """
    return _detected(df, _text(df, None), types=True)


def detect_all(df: DataFrame) -> Plan:
    """What `detect_numbers` finds, and `detect_types` for the other text columns, by one job."""
    return _detected(df, _text(df, None), numbers=True, types=True)


def _number_asks(i: int, c: Column) -> list[Column]:
    return [
        F.count(parse_integer(c)).alias(f"i{i}"),
        F.count(parse_integer(c, WIDE)).alias(f"w{i}"),
        F.count_if(is_whole(c)).alias(f"a{i}"),
        F.count(parse_number(c)).alias(f"f{i}"),
        F.count_if(c.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"t{i}"),
    ]


def _detected(
    df: DataFrame, names: Sequence[str], numbers: bool = False, types: bool = False
) -> Plan:
    if not names:
        return {}
    asks = []
    for i, n in enumerate(names):
        c = col(n)
        asks.append(F.count(c).alias(f"n{i}"))
        asks += _number_asks(i, c) if numbers else []
        asks += [*_date_asks(i, c), *_currency_asks(i, c), *_boolean_asks(i, c)] if types else []
    row = df.agg(*asks).first()
    plan: Plan = {}
    for i, n in enumerate(names):
        present = row[f"n{i}"]
        if not present:
            continue
        if numbers and row[f"i{i}"] == present:
            plan[n] = Step("integer")
        elif numbers and row[f"a{i}"] == present:
            # Digits beyond 64 bits are kept; beyond 38 of them the column stays text.
            if row[f"w{i}"] == present:
                plan[n] = Step("wide")
        elif numbers and row[f"f{i}"] == present:
            plan[n] = Step("number")
        elif numbers and row[f"t{i}"] == present:
            plan[n] = Step("boolean")
        elif types and (pattern := _best_date(row, i)):
            plan[n] = Step("date", pattern)
        elif types and _is_currency(row, i):
            plan[n] = Step("currency")
        elif types and row[f"k{i}"] == present and row[f"u{i}"] <= 2:
            plan[n] = Step("boolean")
    return plan


def convert_types(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    return apply_plan(df, detect_types(df) if plan is None else plan)


def blank_na_tokens(df: DataFrame) -> DataFrame:
    """Texts that mean missing become NULL, without trimming."""
    return df.withColumns({n: na_to_null(col(n)) for n in _text(df, None)})


def plan_frame(df: DataFrame, plan: Plan) -> DataFrame:
    """A plan as rows: `column`, `kind`, `pattern`."""
    rows = [(n, s.kind, s.pattern) for n, s in plan.items()]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, pattern string")


__all__ = [
    "Plan", "Step", "apply_plan", "blank_na_tokens", "convert_types", "detect_all",
    "detect_booleans", "detect_currency", "detect_dates", "detect_numbers", "detect_types",
    "plan_frame", "to_boolean",
]
