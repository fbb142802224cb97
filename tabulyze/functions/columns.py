"""Name quoting, column roles and missing-value folding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERICAL = "numerical"
CATEGORICAL = "categorical"
DATETIME = "datetime"
OTHER = "other"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column with exactly this name, dots and spaces included."""
    return F.col(quoted(name))


def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERICAL
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def column_types(df: DataFrame) -> dict[str, list[str]]:
    """Column names by role, in schema order."""
    found: dict[str, list[str]] = {NUMERICAL: [], CATEGORICAL: [], DATETIME: []}
    for field in df.schema.fields:
        role = role_of(field.dataType)
        if role in found:
            found[role].append(field.name)
    return found


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Numeric columns, optionally only those of `columns`, in that order."""
    numeric = column_types(df)[NUMERICAL]
    if columns is None:
        return numeric
    known = set(numeric)
    return [name for name in columns if name in known]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN for floating-point columns."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold NaN into NULL, so that one marker means missing everywhere after."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    if not floating:
        return df
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floating})


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a NULL in any column, whatever the columns are called."""
    if not df.columns:
        return df
    return df.filter(reduce(and_, [col(c).isNotNull() for c in df.columns]))


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """`wanted`, with underscores added while the table has a column of that name."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def as_double(name: str) -> Column:
    return col(name).cast("double")


def tie_break(df: DataFrame, keys: Sequence[str] | None, *first: str) -> list[str]:
    """Explicit key columns, or every orderable column not already sorted by."""
    if keys:
        return [k for k in keys if k not in first]
    return [
        f.name
        for f in df.schema.fields
        if f.name not in first and role_of(f.dataType) != OTHER
    ]
