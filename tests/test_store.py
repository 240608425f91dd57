"""Stores that are opened again, and what other writers and half-written versions do to them."""

import hashlib
import json

import pytest
from colligo.sources.catalog import Catalog
from colligo.sources.files import Files, Taken
from colligo.sources.tables import Store


def rows(spark, *values):
    return spark.createDataFrame(values, "employee_id string, shift_start string")


def content(df):
    return sorted(tuple(r[c] for c in ("employee_id", "shift_start")) for r in df.collect())


def test_opened_again(spark, tmp_path):
    """Rows, appended columns, mappings and patterns of a store are those of one opened on its folder."""
    folder = f"file://{tmp_path}/store"
    first = Store(spark, folder)
    assert first.status() == [] and not first.has("shifts")
    first.load(rows(spark, ("007", "08:00"), ("2", "x")), "employee_shifts", confidence=0.5)
    first.load(rows(spark, ("3", "09:00")).withColumnRenamed("employee_id", "emp").selectExpr("*", "'W' AS ward"), "employee_shifts", {"emp": "employee_id"}, replace=False)
    first.load(rows(spark, ("1", "1")), "9 pay")
    again = Store(spark.newSession(), folder)
    assert [x.name for x in again.status()] == ["employee_shifts", "t_9_pay"] and again.has("employee_shifts")
    assert content(again.tables()["employee_shifts"]) == content(first.tables()["employee_shifts"]) == [("007", "08:00"), ("2", "x"), ("3", "09:00")]
    assert again.status()[0] == first.status()[0] and again.status()[0].mappings == {"emp": "employee_id"} and "ward" in again.status()[0].columns
    assert "shift_cluster_id" in again.status()[0].columns
    assert again.sql("SELECT count(*) AS n FROM employee_shifts WHERE ward = :w", w="W").first()["n"] == 1
    assert again.drop("9 pay") and not again.drop("9 pay") and not Store(spark, folder).has("9 pay")
    first.refresh()
    assert not first.has("9 pay") and [x.name for x in Store(spark, folder, version=3).status()] == ["employee_shifts", "t_9_pay"]
    with pytest.raises(ValueError, match="only read"):
        Store(spark, folder, version=1).load(rows(spark, ("1", "1")), "pay")


def test_half_written_versions_are_not_seen(spark, tmp_path):
    folder = f"{tmp_path}/store"
    store = Store(spark, folder)
    store.load(rows(spark, ("1", "08:00")), "pay")
    catalog, files = Catalog(spark, folder), Files(spark)
    catalog.write("pay", rows(spark, ("2", "08:00")))  # data whose writer died before its manifest
    files.create(catalog._path(2), json.dumps({"pay": {"parts": [], "facts": {}}})[:10])  # and one that died while it wrote one
    assert content(Store(spark, folder).tables()["pay"]) == [("1", "08:00")]
    with pytest.raises(ValueError, match="not whole"):
        Store(spark, folder, version=2)
    store.load(rows(spark, ("3", "08:00")), "pay", replace=False)
    assert catalog.versions() == [1, 2, 3] and content(Store(spark, folder).tables()["pay"]) == [("1", "08:00"), ("3", "08:00")]


def test_writers_meet(spark, tmp_path, monkeypatch):
    """The second writer of a version starts again from the first one's, so neither append is lost."""
    folder = f"{tmp_path}/store"
    catalog, other = Catalog(spark, folder), Catalog(spark, folder)
    catalog.put("t", rows(spark, ("0", "a")))
    numbers = iter([[1], [1, 2]])
    monkeypatch.setattr(catalog, "versions", lambda: next(numbers, [1, 2, 3]))
    other.put("t", rows(spark, ("1", "b")), append=True)
    monkeypatch.setattr(catalog, "entries", lambda version=None: Catalog.entries(other, version))
    assert catalog.put("t", rows(spark, ("2", "c")), append=True) == 3
    assert content(other.frame(other.entries()["t"])) == [("0", "a"), ("1", "b"), ("2", "c")]
    with pytest.raises(Taken):
        other.files.create(other._path(3), "")


def test_compact_and_vacuum(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/store")
    for i in range(4):
        catalog.put("t", rows(spark, (str(i), "a")), append=True)
    assert len(catalog.frame(catalog.entries()["t"]).inputFiles()) >= 4
    assert catalog.compact("t") == 5 and len(catalog.entries()["t"]["parts"]) == 1
    assert len(catalog.vacuum()) == 4 and catalog.versions() == [5]
    assert content(catalog.frame(catalog.entries()["t"])) == [(str(i), "a") for i in range(4)]
    assert hashlib.sha256(catalog.files.read(catalog._path(5)).rpartition("\n")[0].encode()).hexdigest() in catalog.files.read(catalog._path(5))
