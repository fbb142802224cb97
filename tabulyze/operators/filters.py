"""Filters. Each is one predicate, so that Catalyst can push it into the scan."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulyze.functions.columns import CATEGORICAL, DATETIME, col, role_of
from tabulyze.functions.text import parse_timestamp
from tabulyze.operators.roles import require_columns


def _all(parts: Sequence[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def numeric_range(
    df: DataFrame, column: str, min_val: float | None = None, max_val: float | None = None
) -> Column:
    """min_val <= column <= max_val; NaN fails any bound, as NULL does."""
    require_columns(df, column)
    c = col(column)
    parts = []
    if min_val is not None:
        parts.append(c >= F.lit(min_val))
    if max_val is not None:
        parts.append(c <= F.lit(max_val))
    if parts and isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        parts.append(~F.isnan(c))
    return _all(parts)


def _can_hold(dtype: T.DataType, value: Any) -> bool:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return isinstance(value, str)
    if isinstance(dtype, T.NumericType):
        return isinstance(value, (int, float, Decimal))
    return True


def in_values(df: DataFrame, column: str, values: Iterable[Any] | None) -> Column:
    """Membership; an empty list keeps all rows, a None in the list keeps missing ones.

    Values that the column's type cannot hold match nothing.
    """
    require_columns(df, column)
    wanted = list(values or [])
    if not wanted:
        return F.lit(True)
    c = col(column)
    given = [v for v in wanted if v is not None and v == v]
    present = [v for v in given if _can_hold(df.schema[column].dataType, v)]
    keep = F.coalesce(c.isin(*present), F.lit(False)) if present else F.lit(False)
    if len(given) == len(wanted):
        return c.isin(*present) if present else F.lit(False)
    missing = c.isNull()
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(c)
    return keep | missing


def _bound(value: Any, dtype: T.DataType) -> Column:
    """A bound as a literal of the column's own type, so that the filter pushes down."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    zone = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    return F.lit(value.isoformat(sep=" ")).cast(zone)


def date_range(df: DataFrame, column: str, start_date: Any = None, end_date: Any = None) -> Column:
    """Inclusive range. A bare end date means its midnight. Text is parsed first."""
    require_columns(df, column)
    dtype = df.schema[column].dataType
    role = role_of(dtype)
    if role not in (DATETIME, CATEGORICAL):
        raise ValueError(f"Column {column} holds neither dates nor text")
    c = col(column)
    if role == CATEGORICAL:
        c = parse_timestamp(c)
    parts = []
    if start_date is not None:
        parts.append(c >= _bound(start_date, dtype))
    if end_date is not None:
        parts.append(c <= _bound(end_date, dtype))
    return _all(parts)


def filter_numeric_range(
    df: DataFrame, column: str, min_val: float | None = None, max_val: float | None = None
) -> DataFrame:
    return df.filter(numeric_range(df, column, min_val, max_val))


def filter_in_values(df: DataFrame, column: str, values: Iterable[Any] | None) -> DataFrame:
    return df.filter(in_values(df, column, values))


def _with_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    text = [c for c in dict.fromkeys(columns) if role_of(df.schema[c].dataType) == CATEGORICAL]
    return df.withColumns({c: parse_timestamp(col(c)) for c in text}) if text else df


def filter_date_range(
    df: DataFrame, column: str, start_date: Any = None, end_date: Any = None
) -> DataFrame:
    """Rows in the range; a text column comes back as timestamps."""
    require_columns(df, column)
    parsed = _with_dates(df, [column])
    return parsed.filter(date_range(parsed, column, start_date, end_date))


def predicate(df: DataFrame, filters: Iterable[dict[str, Any]]) -> Column:
    """The conjunction of filter specs; specs of an unknown type are ignored."""
    parts = []
    for spec in filters:
        kind, column = spec.get("type"), spec.get("column")
        if kind == "numerical":
            parts.append(numeric_range(df, column, spec.get("min_val"), spec.get("max_val")))
        elif kind == "categorical":
            parts.append(in_values(df, column, spec.get("values")))
        elif kind == "date":
            parts.append(
                date_range(df, column, spec.get("start_date"), spec.get("end_date"))
            )
    return _all(parts)


def apply_filters(df: DataFrame, filters: Iterable[dict[str, Any]]) -> DataFrame:
    """Rows that pass every spec; text columns under a date spec come back as timestamps."""
    specs = list(filters)
    dated = [s["column"] for s in specs if s.get("type") == "date"]
    require_columns(df, dated)
    kept = df.filter(predicate(df, specs))
    return _with_dates(kept, dated)


def filter_row_counts(df: DataFrame, filters: Iterable[dict[str, Any]]) -> DataFrame:
    """Rows before and after the filters, from one pass: `total`, `remaining`."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(predicate(df, filters)).alias("remaining")
    )
