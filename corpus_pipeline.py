"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and
rereads it as the next stage's docs. All but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm import decontamination, packing, pii, quality, simhash
from tabulyze.llm.queries import table, tokenizer_definition
from tabulyze.llm.shipping import ship
from tabulyze.llm.stamping import unused, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts are too short and go."""
    ship(spark)
    rules, m = quality.RepetitionRules(), unused("measures", docs)
    judged = docs.withColumn(m, quality.measures(F.col("text"), rules))
    failed = quality.base_failed(F.col(m), rules) | quality.over_limit(F.col(m), rules)
    return judged.filter(~failed).drop(m)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their fingerprints the one with the smallest id.

    Null ids come last; among rows with the same id any one stays. Texts without words are one
    group.
    """
    ship(spark)
    return simhash.one_of_each(docs, shingle_words=simhash.SHINGLE_WORDS,
                               distance=simhash.MAX_DISTANCE)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; texts without words stay."""
    ship(spark)
    row = unused("row_uid", docs)
    marked, hits = decontamination.contaminated_rows(
        docs, table(spark, sf_dir, "benchmark"), row=row)
    return marked.join(hits, row, "left_anti").select(*(col(c) for c in docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(
            F.length("text").cast(kind), F.col("n_chars")))
    return clean.select(*(col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and place in sequences of 2048 tokens.

    A null or empty text is a piece that holds the end id alone.
    """
    ship(spark)
    return packing.packed(docs, tokenizer_definition(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack),
]

#: Tokenizers and fingerprints are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
