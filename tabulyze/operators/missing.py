"""Missing values and duplicate rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tabulyze.functions.columns import (
    CATEGORICAL, as_double, col, column_types, complete_rows, free_name, is_missing, nan_to_null,
    numeric_columns,
)
from tabulyze.functions.order_stats import VALUE_LIMIT, quantile_values
from tabulyze.operators.ranking import column_modes


def _gappy(df: DataFrame, names: list[str]) -> list[str]:
    """Columns with a missing value; one row reaches the driver."""
    if not names:
        return []
    row = df.agg(*[F.bool_or(is_missing(df, c)).alias(f"g{i}") for i, c in enumerate(names)])
    return [c for c, gap in zip(names, row.first()) if gap]


def _filled(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fill columns that have gaps: whole numbers become doubles, decimals stay decimals.

    Columns without a gap keep their type and every digit.
    """
    def fill(c: str, v: float | None) -> Column:
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.DecimalType):
            return col(c) if v is None else F.coalesce(col(c), F.lit(v).try_cast(dtype))
        return as_double(c) if v is None else F.coalesce(as_double(c), F.lit(float(v)))

    return nan_to_null(df).withColumns({c: fill(c, v) for c, v in values.items()})


def fill_mean(df: DataFrame) -> DataFrame:
    names = _gappy(df, numeric_columns(df))
    if not names:
        return df
    means = nan_to_null(df).agg(*[F.avg(as_double(c)) for c in names]).first()
    return _filled(df, dict(zip(names, means)))


def fill_median(df: DataFrame, limit: int = VALUE_LIMIT) -> DataFrame:
    names = _gappy(df, numeric_columns(df))
    if not names:
        return df
    medians = quantile_values(df, names, [0.5], limit)
    return _filled(df, {c: medians[c][0] for c in names})


def fill_mode(df: DataFrame) -> DataFrame:
    """Text columns get their most frequent value, the smallest on ties."""
    text = column_types(df)[CATEGORICAL]
    if not text:
        return df
    modes = {row["column"]: row["value"] for row in column_modes(df, text).collect()}
    return df.withColumns({c: F.coalesce(col(c), F.lit(modes[c])) for c in text if c in modes})


def handle_missing(df: DataFrame, strategy: str = "none") -> DataFrame:
    """none, drop, fill_mean, fill_median or fill_mode; any other name changes nothing."""
    if strategy == "drop":
        return complete_rows(nan_to_null(df))
    if strategy == "fill_mean":
        return fill_mean(df)
    if strategy == "fill_median":
        return fill_median(df)
    if strategy == "fill_mode":
        return fill_mode(df)
    return df


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def _comparable(c: Column, dtype: T.DataType) -> Column:
    """The same value with maps, at any depth, as their entries in order."""
    if not _has_map(dtype):
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _comparable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_comparable(c[f.name], f.dataType).alias(f"f{i}")
                  for i, f in enumerate(dtype.fields)]
        return F.when(c.isNotNull(), F.struct(*fields))
    return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
        _comparable(e["key"], dtype.keyType).alias("key"),
        _comparable(e["value"], dtype.valueType).alias("value"))))


def dedupe_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop repeated rows; missing equals missing, and maps are equal if their entries are."""
    kept = list(columns) if columns else df.columns
    maps = [c for c in kept if _has_map(df.schema[c].dataType)]
    if not maps:
        return df.dropDuplicates(kept)
    keys = {c: free_name(f"{c}_entries", df.columns) for c in maps}
    keyed = df.withColumns({k: _comparable(col(c), df.schema[c].dataType)
                            for c, k in keys.items()})
    return keyed.dropDuplicates([keys.get(c, c) for c in kept]).drop(*keys.values())


def dedupe_observed(
    df: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """`dedupe_rows`, and a function that tells `rows` left and `removed`.

    Both are counted while the frame is computed for the first time, without a job of their own;
    before that the function waits.
    """
    seen, left = Observation(), Observation()
    one = F.count(F.lit(1)).alias("rows")
    kept = dedupe_rows(df.observe(seen, one), columns).observe(left, one)

    def counts() -> dict[str, int]:
        rows = left.get["rows"]
        return {"rows": rows, "removed": seen.get["rows"] - rows}

    return kept, counts
