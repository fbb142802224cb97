import datetime as dt

import pytest

from tabulyze.operators.conversion import Step
from tabulyze.plans.prepare import prepare_table
from tabulyze.sources import (
    SourceRegistry, export_csv, load_table, read_csv, read_json, read_tsv, sources,
)
from tabulyze.sources.readers import json_layout, text_facts


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_minimal(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "a.csv", "col1,col2\n1,2\n3,4\n"))
    assert df.dtypes == [("col1", "bigint"), ("col2", "bigint")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)]


def test_csv_types_and_missing(spark, tmp_path):
    text = 'n,f,b,t,m\n1,1.5,True,x,NA\n,N/A,False,"a ""b"", c",\n3,2,,,""\n'
    df = read_csv(spark, write(tmp_path, "a.csv", text))
    assert dict(df.dtypes) == {
        "n": "bigint", "f": "double", "b": "boolean", "t": "string", "m": "string",
    }
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted([
        (1, 1.5, True, "x", None), (None, None, False, 'a "b", c', None),
        (3, 2.0, None, None, None),
    ], key=str)


def test_csv_field_over_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'k,t\n1,"two\nlines"\n2,plain\n')
    assert text_facts(spark, path) == (True, True)
    rows = sorted(tuple(r) for r in read_csv(spark, path).collect())
    assert rows == [(1, "two\nlines"), (2, "plain")]


def test_csv_latin1(spark, tmp_path):
    path = write(tmp_path, "a.csv", "k,t\n1,Café\n2,plain\n", "latin-1")
    assert text_facts(spark, path)[0] is False
    rows = sorted(tuple(r) for r in read_csv(spark, path).collect())
    assert rows == [(1, "Café"), (2, "plain")]


def test_csv_of_mixed_encodings(spark, tmp_path):
    folder = tmp_path / "both files.csv"
    folder.mkdir()
    write(folder, "a.csv", "k,t\n1,Café\n")
    write(folder, "b.csv", 'k,t\n2,"Café"\n', "latin-1")
    write(folder, "c.csv", 'k,t\n3,"Café\nnoir"\n', "latin-1")
    rows = sorted(tuple(r) for r in read_csv(spark, str(folder)).collect())
    assert rows == [(1, "Café"), (2, "Café"), (3, "Café\nnoir")]
    assert text_facts(spark, str(folder / "b.csv")) == (False, False)


def test_prepare_with_everything_given_runs_no_job(spark, tmp_path):
    path = write(tmp_path, "a.csv", "k,day,ok\n1,2024-01-02,yes\n1,2024-01-02,yes\n2,,no\n")
    found = prepare_table(spark, path)
    assert dict(found.dtypes) == {"k": "bigint", "day": "timestamp_ntz", "ok": "boolean"}
    context = spark.sparkContext
    context.setJobGroup("given", "given")
    given = prepare_table(
        spark, path, plan={"day": Step("date", "yyyy-MM-dd"), "ok": Step("boolean")},
        reader={"encoding": "UTF-8", "multiline": False, "columns": ["k", "day", "ok"],
                "plan": {"k": Step("integer")}})
    jobs = context.statusTracker().getJobIdsForGroup("given")
    context.setJobGroup("", "")
    assert len(jobs) == 0
    assert sorted(map(str, given.collect())) == sorted(map(str, found.collect()))


def test_csv_plan_skips_detection(spark, tmp_path):
    path = write(tmp_path, "a.csv", "k\n007\n")
    kept = read_csv(spark, path, plan={}, encoding="UTF-8", multiline=False)
    assert kept.first()[0] == "007"


def test_tsv(spark, tmp_path):
    df = read_tsv(spark, write(tmp_path, "a.tsv", "a\tb\n1\tx,y\n"))
    assert [tuple(r) for r in df.collect()] == [(1, "x,y")]


@pytest.mark.parametrize("text, layout", [
    ('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', "records"),
    ('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n', "lines"),
    ('{"a":{"0":1,"1":2},"b":{"0":"x","1":"y"}}', "columns"),
    ('{\n  "a": {"0": 1, "1": 2},\n  "b": {"0": "x", "1": "y"}\n}', "columns"),
])
def test_json_layouts(spark, tmp_path, text, layout):
    path = write(tmp_path, "a.json", text)
    assert json_layout(spark, path) == layout
    assert sorted(tuple(r) for r in read_json(spark, path).collect()) == [(1, "x"), (2, "y")]


def test_json_columns_with_gaps(spark, tmp_path):
    path = write(tmp_path, "a.json", '{"a":{"0":1.5,"1":null},"b":{"0":null,"1":"y"}}')
    rows = sorted((tuple(r) for r in read_json(spark, path).collect()), key=str)
    assert rows == [(1.5, None), (None, "y")]


def test_dispatch(spark, tmp_path, parcels):
    path = write(tmp_path, "A.CSV", "x\n1\n")
    assert load_table(spark, path).count() == 1
    parquet = str(tmp_path / "e.parquet")
    parcels.write.parquet(parquet)
    assert load_table(spark, parquet).count() == 6
    with pytest.raises(FileNotFoundError, match="File not found"):
        load_table(spark, str(tmp_path / "nonexistent.csv"))
    for name in ("a.txt", "b.xlsx", "plain"):
        with pytest.raises(ValueError, match="Unsupported file format"):
            load_table(spark, write(tmp_path, name, "x"))


def test_register(spark, tmp_path):
    registry = SourceRegistry()
    registry.register(".PSV", lambda session, p: session.read.csv(p, sep="|", header=True))
    path = write(tmp_path, "a.psv", "a|b\n1|2\n")
    assert registry.load(spark, path).columns == ["a", "b"]
    assert registry.extensions() == [".psv"]
    assert len(sources.readers) >= 4


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "q", b', None, dt.datetime(2024, 1, 1, 2, 3, 4)),
         (2, " padded ", 2.5, dt.datetime(2024, 1, 2, 0, 0, 0, 120000)),
         (3, None, 1e20, None)],
        "k long, t string, v double, ts timestamp_ntz",
    )
    path = str(tmp_path / "out.csv")
    assert export_csv(df, path) is True
    back = prepare_table(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert export_csv(df, "nowhere://x/y.csv") is False


def test_prepare(spark, tmp_path):
    text = "price,date,flag\n$100,2024-01-01,TRUE\n$200,2024-01-02,no\n$100,2024-01-01,TRUE\n"
    path = write(tmp_path, "a.csv", text)
    df = prepare_table(spark, path)
    assert df.count() == 2
    assert [t for _, t in df.dtypes] == ["double", "timestamp_ntz", "boolean"]
    raw = prepare_table(spark, path, clean=False, remove_duplicates=False)
    assert raw.count() == 3 and raw.dtypes[0][1] == "string"
