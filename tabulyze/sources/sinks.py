"""Writers."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, types as T

from tabulyze.functions.columns import col

log = logging.getLogger(__name__)


def export_csv(df: DataFrame, path: str, sep: str = ",") -> bool:
    """Write delimited text with a header, missing as empty; False when writing fails.

    The path becomes a folder with one file per task.
    """
    stamps = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    ]
    # Fractions of a second are written only where there are any.
    shown = df.withColumns({c: col(c).cast("string") for c in stamps}) if stamps else df
    try:
        (
            shown.write.mode("overwrite").option("header", True).option("sep", sep)
            .option("quote", '"').option("escape", '"').option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    except Exception as error:  # any failure is reported as a result, not raised
        log.error("Error exporting to CSV: %s", error)
        return False
    return True
