"""Many files in one plan against one table at a time."""

import pytest
from colligo.plans import batch
from colligo.plans.classify import classify
from colligo.sources import many, schemas
from colligo.sources.tables import converted, read_csv
from pyspark.sql import functions as F

SHIFTS = "emp_id,shift_date,start_time,end_time,dur_hrs\nE001,13/01/2024,2024-01-01 07:00,2024-01-01 15:00,8\nE002,02/01/2024,2024-01-02 15:00,2024-01-02 23:00,8\nE003,03/01/2024,2024-01-03 23:00,2024-01-04 07:00,8\n"
PAY = "emp_id,employee_name,contract_type,hourly_rate\nE001,Ann,full,20.5\nE002,Bob,part,19.0\n"


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.csv": SHIFTS, "b 1+2%.csv": PAY, "quoted.csv": '﻿id,"note, long",x\r\n1,"two\nlines, ""said""",\r\n\r\n2,plain\n3,more,y,beyond\n', "header.csv": "a,b\n", "twice.csv": "a,a\n1,2\n",
        "noname.csv": "a,,c\n1,2,3\n", "open.csv": 'a,b\n1,"never closed\n2,x\n', "empty.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return tmp_path


def test_read(spark, folder):
    cells, files = many.read(spark, str(folder))
    told = {r["file"]: (r["columns"], r["rows"], r["error"]) for r in files.collect()}
    assert told == {f"{folder}/{k}": v for k, v in {"a.csv": (5, 3, None), "b 1+2%.csv": (4, 2, None), "quoted.csv": (3, 3, None), "header.csv": (2, 0, None), "twice.csv": (2, 1, "a name is there twice"), "noname.csv": (3, 1, "a column has no name"), "open.csv": (2, 1, None)}.items()}
    quoted = cells.where(F.col("file").endswith("quoted.csv")).orderBy("row", "column_position").collect()
    assert [(r["column_name"], r["value"]) for r in quoted] == [("id", "1"), ("note, long", 'two\nlines, "said"'), ("x", None), ("id", "2"), ("note, long", "plain"), ("x", None), ("id", "3"), ("note, long", "more"), ("x", "y")]
    few, files = many.read(spark, str(folder), rows=1)
    assert few.select("file", "row").distinct().groupBy("file").count().where("count > 1").isEmpty() and {r["value"] for r in few.where(F.col("file").endswith("a.csv")).collect()} >= {"E001"}
    assert files.agg(F.max("rows")).first()[0] == 1


def test_classified_as_one_by_one(spark, folder):
    cells, files = many.read(spark, str(folder), rows=500)
    fields = schemas.fields(spark)
    got = batch.classify(cells, files, fields)
    assert {r["file"].rsplit("/", 1)[1]: r["document_type"] for r in got.types.collect()}["a.csv"] == "employee_shifts"
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in got.errors.collect()} == {"header.csv": "no rows", "twice.csv": "a name is there twice", "noname.csv": "a column has no name"}
    for name in ("a.csv", "b 1+2%.csv"):
        alone = classify(read_csv(spark, str(folder / name)), fields=fields)
        here = F.col("file") == f"{folder}/{name}"
        scores = lambda df: [(r["document_type"], round(r["score"], 4)) for r in df.orderBy("rank").collect() if r["score"] > 0]
        assert scores(got.scores.where(here)) == scores(alone.scores)
        rows = lambda df: sorted((r["column_name"], r["target_field"], round(r["confidence"], 4), r["status"]) for r in df.collect())
        assert rows(got.suggestions.where(here)) == rows(alone.suggestions)


def test_date_format_is_attached(spark, folder):
    """Day and month are told apart by the whole column, and a load with the conversion gives ISO dates."""
    table = read_csv(spark, str(folder / "a.csv"))
    found = classify(table)
    assert found.mappings["shift_date"] == "shift_date" and found.conversions["shift_date"] == ("DD/MM/YYYY", "YYYY-MM-DD")
    assert [r["shift_date"] for r in converted(table, found.conversions).orderBy("_row").collect()] == ["2024-01-13", "2024-01-02", "2024-01-03"]


def test_ingest(spark, folder):
    cells, files = many.read(spark, str(folder), rows=500)
    records = [("one", f"{folder}/a.csv", "m", "employee_shifts", {"emp_id": "employee_id"}), ("two", f"{folder}/a.csv", "m", "employee_shifts", {}), ("three", f"{folder}/b 1+2%.csv", "m", "pay", {"nope": "x", "emp_id": "y"}), ("four", f"{folder}/empty.csv", "m", "pay", {}), ("five", f"{folder}/twice.csv", "m", "pay", {}), ("six", f"{folder}/header.csv", "m", "pay", {})]
    examples, known, told = batch.ingest(spark.createDataFrame(records, "item_id string, file string, vertical string, document_type string, column_mappings map<string,string>"), cells, files)
    assert {r["item_id"]: r["error"] for r in told.collect()} == {"one": None, "two": None, "three": "not in the table: nope", "four": "no such file, or an empty one", "five": "a name is there twice", "six": "no rows"}
    assert sorted(r["item_id"] for r in examples.collect()) == ["one", "two"] and [tuple(r) for r in known.collect()] == [("m", "employee_shifts", "emp_id", "employee_id")]
    again = batch.classify(cells, files, schemas.fields(spark), examples.select("item_id", "document_type", "vector"))
    assert again.scores.where(F.col("file").endswith("a.csv") & (F.col("rank") == 1)).first()["document_score"] > 0.99
