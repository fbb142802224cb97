"""Readers for delimited text, JSON and Parquet, chosen by file extension."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import (
    Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T,
)

from tabulyze.functions.columns import col, free_name
from tabulyze.operators.conversion import Plan, apply_plan, blank_na_tokens, detect_numbers

Reader = Callable[..., DataFrame]
Detect = Callable[[DataFrame], Plan]


def _exists(spark: SparkSession, path: str) -> None:
    try:
        spark.read.format("text").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `utf8` (all its lines are), `spans` (a quoted field spans lines), by one splittable
    pass. A file without lines is not listed."""
    # Read as Latin-1, a quote is a quote whatever the encoding of the line.
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("spans"),
    )


def text_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(all lines are UTF-8, some quoted field spans lines), of all files of a path."""
    return tuple(file_facts(spark, path).agg(
        F.coalesce(F.bool_and("utf8"), F.lit(True)), F.coalesce(F.bool_or("spans"), F.lit(False)),
    ).first())


def _file_groups(
    spark: SparkSession, path: str, encoding: str | None, multiline: bool | None
) -> dict[tuple[str, bool], str | list[str]]:
    """The files of a path by how they are to be read: (encoding, fields span lines)."""
    if encoding is not None and multiline is not None:
        return {(encoding, multiline): path}
    groups: dict[tuple[str, bool], list[str]] = {}
    for file, utf8, spans in file_facts(spark, path).collect():  # one row per file
        how = (encoding or ("UTF-8" if utf8 else "ISO-8859-1"),
               spans if multiline is None else multiline)
        groups.setdefault(how, []).append(unquote(file))
    if len(groups) > 1:
        return {how: sorted(files) for how, files in sorted(groups.items())}
    return {how: path for how in groups or [(encoding or "UTF-8", bool(multiline))]}


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    encoding: str | None = None,
    multiline: bool | None = None,
    plan: Plan | None = None,
    surplus: str | None = None,
    columns: Sequence[str] | None = None,
    detect: Detect = detect_numbers,
) -> DataFrame:
    """Delimited text with a header, columns typed by their content.

    A line with more fields than the header raises when it is read; with `surplus`, a column of
    that name holds the first field beyond the header instead.

    Encoding falls back from UTF-8 to Latin-1, file by file. Files are split among tasks unless
    a quoted field of theirs spans lines. Both are found by one scan, the types by another, by
    `detect`; `encoding`, `multiline`, `plan` and `columns` (the header's names) skip the scans.
    """
    _exists(spark, path)

    def reader(encoding: str, multiline: bool, files: str | list[str]) -> DataFrameReader:
        found = (
            spark.read.option("header", True).option("sep", sep)
            .option("quote", '"').option("escape", '"')
            .option("encoding", encoding).option("multiLine", multiline)
        )
        plain = isinstance(files, str) or any(mark in path for mark in "*?[{")
        return found if plain else found.option("basePath", path)

    groups = _file_groups(spark, path, encoding, multiline)
    if columns is None:
        how, files = next(iter(groups.items()))
        header = reader(*how, files).csv(files).schema
    else:
        header = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    extra = surplus or free_name("surplus", header.names)
    schema = T.StructType([*header.fields, T.StructField(extra, T.StringType())])
    raw = reduce(DataFrame.unionByName, [
        reader(*how, files).schema(schema).csv(files) for how, files in groups.items()])
    if surplus is None:
        told = F.concat(F.lit(f"A line of {path} has more fields than the header: "), col(extra))
        raw = raw.select(*[
            F.when(col(extra).isNull(), col(c)).otherwise(F.raise_error(told)).alias(c)
            for c in header.names
        ])
    texts = blank_na_tokens(raw)
    return apply_plan(texts, detect(texts) if plan is None else plan)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise


def _column_shaped(text: Column) -> Column:
    """Every member an object, all with the same row numbers as keys."""
    m = F.from_json(text, "map<string,map<string,string>>")
    first = F.array_sort(F.map_keys(F.get(F.map_values(m), F.lit(0))))
    return F.coalesce(
        (F.size(m) > 0) & (F.size(first) > 0)
        & F.forall(first, lambda k: k.rlike(r"^-?\d+$"))
        & F.forall(F.map_values(m), lambda v: v.isNotNull()
                   & F.coalesce(F.array_sort(F.map_keys(v)) == first, F.lit(False))),
        F.lit(False),
    )


def json_layout(spark: SparkSession, path: str) -> str:
    """'records' for an array, 'columns' for {"col": {"0": v}}, else 'lines'.

    All lines of all files are looked at. Lines that are objects by themselves are 'lines', unless
    each file is a single one and column-shaped; otherwise whole files decide.
    """
    value = F.trim(F.ltrim(F.col("value"), F.lit("\ufeff")))
    lines = spark.read.text(path).select(
        value.alias("value"), F.input_file_name().alias("file")).filter("value <> ''")
    alone = F.col("value").startswith("{") & F.try_parse_json("value").isNotNull()
    n, files, all_alone = lines.agg(
        F.count(F.lit(1)), F.count_distinct("file"), F.bool_and(alone)).first()
    if not n:
        return "lines"
    if all_alone:
        # Only where each file is one line can that line be a whole table.
        shaped = n == files and lines.agg(F.bool_and(_column_shaped(F.col("value")))).first()[0]
        return "columns" if shaped else "lines"
    whole = spark.read.text(path, wholetext=True).select(value.alias("value"))
    shaped = whole.filter("value <> ''").agg(F.bool_and(_column_shaped(F.col("value")))).first()[0]
    if shaped:
        return "columns"
    starts = whole.agg(F.bool_or(F.col("value").rlike(r"^\s*\["))).first()[0]
    return "records" if starts or n > files else "lines"


def _read_json_columns(spark: SparkSession, path: str) -> DataFrame:
    """One file is one task's record; many files run side by side."""
    texts = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"),
        F.from_json("value", "map<string,map<string,string>>").alias("m"),
    ).withColumn("m", F.when(F.col("m").isNotNull(), F.col("m")).otherwise(F.raise_error(
        F.concat(F.lit("Not column-oriented JSON: "), F.col("file")))))
    # The names of the columns, as many as the schema has.
    names = [
        row[0]
        for row in texts.select(F.posexplode(F.map_keys("m")).alias("pos", "name"))
        .groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name")
        .select("name").collect()
    ]
    cells = (
        texts.select("file", F.explode("m").alias("name", "cells"))
        .select("file", "name", F.explode("cells").alias("row", "value"))
    )
    return (
        cells.groupBy("file", "row")
        .agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
        .select(*[col(n) for n in names])
    )


def read_json(
    spark: SparkSession, path: str, layout: str | None = None, plan: Plan | None = None,
    detect: Detect = detect_numbers,
) -> DataFrame:
    """JSON records, JSON lines or column-oriented JSON; the layout is looked up if not given.

    Text columns that hold only numbers become numbers.
    """
    _exists(spark, path)
    layout = layout or json_layout(spark, path)
    if layout == "columns":
        rows = _read_json_columns(spark, path)
    elif layout in ("records", "lines"):
        rows = spark.read.option("multiLine", layout == "records").json(path)
    else:
        raise ValueError(f"Unsupported JSON layout: {layout}")
    return apply_plan(rows, detect(rows) if plan is None else plan)


class SourceRegistry:
    """Readers by extension. The first one registered for an extension wins."""

    def __init__(self) -> None:
        self.readers: list[tuple[str, Reader]] = []

    def register(self, extension: str, reader: Reader) -> None:
        self.readers.append((extension.lower(), reader))

    def extensions(self) -> list[str]:
        return list(dict.fromkeys(ext for ext, _ in self.readers))

    def reader(self, path: str) -> Reader:
        name = str(path).rstrip("/")
        for extension, reader in self.readers:
            if name.lower().endswith(extension):
                return reader
        base = name.rsplit("/", 1)[-1]
        suffix = "." + base.rsplit(".", 1)[-1] if "." in base else ""
        raise ValueError(
            f"Unsupported file format: {suffix}. "
            f"Supported formats: {', '.join(self.extensions())}"
        )

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        """Read by extension; options go to the reader."""
        name = str(path).rstrip("/")
        _exists(spark, name)
        return self.reader(name)(spark, name, **options)


sources = SourceRegistry()
sources.register(".csv", read_csv)
sources.register(".json", read_json)
sources.register(".parquet", read_parquet)
sources.register(".tsv", read_tsv)


#: Readers that type text columns and take `detect` for it.
TYPING = (read_csv, read_json, read_tsv)


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    return sources.load(spark, path, **options)


def register_source(extension: str, reader: Reader) -> None:
    sources.register(extension, reader)


__all__ = [
    "SourceRegistry", "file_facts", "json_layout", "load_table", "read_csv", "read_delimited",
    "read_json", "read_parquet", "read_tsv", "register_source", "sources", "text_facts",
]
