"""Column roles, projections and input checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tabulyze.functions.columns import (
    col, column_types, complete_rows, is_missing, nan_to_null, numeric_columns, role_of,
    tie_break,
)

ROLE_SCHEMA = "position int, column string, role string"


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column that has a role: `position`, `column`, `role`."""
    kept = [
        (i, f.name, role_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
        if role_of(f.dataType) != "other"
    ]
    return df.sparkSession.createDataFrame(kept, ROLE_SCHEMA)


def role_counts(df: DataFrame) -> DataFrame:
    """Column roles with the number of values present in each column, from one pass."""
    kept = [f.name for f in df.schema.fields if role_of(f.dataType) != "other"]
    counted = df.agg(*[F.count_if(~is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(kept)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(role_of(df.schema[c].dataType)).alias("role"),
                F.col(f"n{i}").alias("present"),
            )
            for i, c in enumerate(kept)
        ]
    )
    return counted.select(F.inline(rows))


def select_numeric(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    if columns is not None:
        columns = list(columns)
        require_columns(df, columns)
    return df.select(*[col(c) for c in numeric_columns(df, columns)])


def project_complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The asked columns, without rows that miss any of them."""
    require_columns(df, columns)
    return complete_rows(nan_to_null(df.select(*[col(c) for c in columns])))


def preview_head(df: DataFrame, keys: Sequence[str] | None = None, rows: int = 100) -> DataFrame:
    """The first rows by the key columns; Spark tables have no order of their own."""
    return df.orderBy(*[col(k) for k in tie_break(df, keys)]).limit(rows)


def distinct_choices(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """Up to `limit` distinct values in ascending order, for a picker."""
    require_columns(df, [column])
    values = complete_rows(nan_to_null(df.select(col(column)))).distinct()
    return values.orderBy(col(column)).limit(limit)


# The messages of this check and the next.
def require_columns(df: DataFrame, columns: str | Sequence[str]) -> None:
    """Names are compared as written; Spark's resolver would ignore case."""
    asked = [columns] if isinstance(columns, str) else list(columns)
    missing = [c for c in asked if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found in DataFrame: {', '.join(missing)}")


def require_nonempty(df: DataFrame) -> None:
    """Runs a one-row job; skip it when the table is known to have rows."""
    if df is None:
        raise ValueError("DataFrame cannot be None")
    if not isinstance(df, DataFrame):
        raise ValueError(f"Expected a Spark DataFrame, got {type(df)}")
    if not df.columns or df.isEmpty():
        raise ValueError("DataFrame is empty")


def is_numerical(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


__all__ = [
    "column_roles", "column_types", "distinct_choices", "is_numerical", "preview_head",
    "project_complete_rows", "require_columns", "require_nonempty", "role_counts",
    "select_numeric",
]
