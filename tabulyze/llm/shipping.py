"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="tabulyze-"), "tabulyze.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tabulyze", os.path.relpath(path, ROOT)))
    context.addPyFile(target)
