import pytest
from pyspark.sql import functions as F

from tabulyze.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value, decimals, shown", [
    (1234567, 2, "1,234,567"), (1234567.89, 2, "1,234,567.89"), (1234.5678, 3, "1,234.568"),
    (0.125, 2, "0.12"), (2.675, 2, "2.67"), (-1234.5, 2, "-1,234.50"),
    (float("nan"), 2, "N/A"), (float("inf"), 2, "inf"), (0, 2, "0"), (12.6, 0, "13"),
])
def test_fmt_number(spark, value, decimals, shown):
    assert one(spark, text.fmt_number(F.lit(value), decimals)) == shown


def test_fmt_number_missing(spark):
    assert one(spark, text.fmt_number(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, text.fmt_number(F.lit(None).cast("bigint"))) == "N/A"


@pytest.mark.parametrize("value, decimals, shown", [
    (0.456, 2, "45.60%"), (0.0, 2, "0.00%"), (1.0, 2, "100.00%"), (0.12345, 3, "12.345%"),
    (float("nan"), 2, "N/A"), (0.5, 0, "50%"), (12.5, 1, "1250.0%"),
])
def test_fmt_percentage(spark, value, decimals, shown):
    assert one(spark, text.fmt_percentage(F.lit(value), decimals)) == shown


@pytest.mark.parametrize("num, den, default, result", [
    (10.0, 2.0, 0.0, 5.0), (10.0, 0.0, 0.0, 0.0), (10.0, 0.0, 99.0, 99.0),
    (10.0, float("nan"), 7.0, 7.0), (None, 2.0, 0.0, None), (None, 0.0, 3.0, 3.0),
])
def test_safe_divide(spark, num, den, default, result):
    made = text.safe_divide(F.lit(num).cast("double"), F.lit(den).cast("double"), default)
    assert one(spark, made) == result


def test_truncate(spark):
    long = "This is a very long text that should be truncated"
    assert one(spark, text.truncate_text(F.lit(long), 20)) == "This is a very lo..."
    assert one(spark, text.truncate_text(F.lit("Short"), 20)) == "Short"
    assert one(spark, text.truncate_text(F.lit(long), 20, ">>")) == "This is a very lon>>"
    assert one(spark, text.truncate_text(F.lit("abcdef"), 2, "...")) == "abcde..."
    assert one(spark, text.truncate_text(F.lit(None).cast("string"), 20)) is None


@pytest.mark.parametrize("value, parsed", [
    ("$1,234.56", 1234.56), ("$966 ", 966.0), ("invalid", None), ("(5)", None), ("1d", None),
    ("€ 12", 12.0), ("£12 ", 12.0), ("-$5", -5.0), ("", None), ("1e3", 1000.0),
    ("nan", None), (".5", 0.5), ("5.", 5.0), ("+7", 7.0), ("0x10", None), ("1 000", 1000.0),
])
def test_clean_currency(spark, value, parsed):
    assert one(spark, text.clean_currency(F.lit(value))) == parsed


@pytest.mark.parametrize("value, parsed", [
    ("2024-01-02", "2024-01-02 00:00:00"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("1/2/2021", "2021-01-02 00:00:00"),
    ("10/19/2021 7:05", "2021-10-19 07:05:00"), ("2024", None), ("85123", None),
    ("12:30", None), ("abc", None), ("2024-13-01", None), ("2024-02-30", None),
])
def test_parse_timestamp(spark, value, parsed):
    made = text.parse_timestamp(F.lit(value)).cast("string")
    assert one(spark, made) == parsed


def test_na_tokens(spark):
    for token in text.NA_TOKENS:
        assert one(spark, text.na_to_null(F.lit(token))) is None
    assert one(spark, text.na_to_null(F.lit(" NA"))) == " NA"
    assert one(spark, text.na_to_null(F.lit("none"))) == "none"
