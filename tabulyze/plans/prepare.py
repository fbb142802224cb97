"""Load, convert and deduplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulyze.operators.conversion import Plan, convert_types, detect_all
from tabulyze.operators.missing import dedupe_rows
from tabulyze.sources.readers import TYPING, load_table, sources


def prepare_table(
    spark: SparkSession,
    path: str,
    clean: bool = True,
    remove_duplicates: bool = True,
    plan: Plan | None = None,
    reader: dict | None = None,
) -> DataFrame:
    """Read by extension, turn text into dates, amounts and truth values, drop copies.

    `reader` holds options of the reader, such as `encoding`, `multiline`, `columns` or its own
    `plan`. Where neither plan is given, one job finds numbers and all other types.
    """
    options = reader or {}
    one_job = (clean and plan is None and "plan" not in options and "detect" not in options
               and sources.reader(path) in TYPING)
    df = load_table(spark, path, **options, **({"detect": detect_all} if one_job else {}))
    if clean and not one_job:
        df = convert_types(df, plan)
    return dedupe_rows(df) if remove_duplicates else df
