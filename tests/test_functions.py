import pytest
from colligo.functions import parsing as P
from colligo.functions import units
from colligo.functions.compatibility import compatibility
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("value, minutes", [("8:05", 485), ("08:00:30", 480), ("24:00", None), ("", None), (None, None), ("abc", None), (" 23:59 ", 1439)])
def test_minutes_of_day(spark, value, minutes):
    assert one(spark, P.minutes_of_day, value) == minutes


@pytest.mark.parametrize("value, seconds", [("90m", 5400), ("1.5h", 5400), ("3600s", 3600), ("30:15", 108900), ("90", None), ("-1.5m", -90), ("x", None), (None, None)])
def test_duration(spark, value, seconds):
    assert one(spark, P.duration_seconds, value) == seconds


@pytest.mark.parametrize("value, day", [("1/6/2024", "2024-06-01"), ("13/06/2024", "2024-06-13"), ("06/13/2024", "2024-06-13"), ("20240601", None), ("2024-6-1", "2024-06-01"), ("31/02/2024", None)])
def test_date(spark, value, day):
    got = one(spark, P.date, value)
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("value, kept", [(" a  b ", "a b"), ("N/A", None), ("--", None), ("", None), ("NaN", None), ("0", "0"), (None, None)])
def test_normalised(spark, value, kept):
    assert one(spark, P.normalised, value) == kept


@pytest.mark.parametrize("value, number", [("$1,200.50", 1200.5), ("₪5", 5.0), ("1e5", None), ("-3", -3.0), ("abc", None)])
def test_number(spark, value, number):
    assert one(spark, P.number, value) == number


def test_text_number(spark):
    rows = spark.createDataFrame([(1e7, "10000000.0"), (2.5, "2.5"), (3.0, "3.0"), (0.126, "0.13")], "v double, t string")
    assert all(r["x"] == r["t"] for r in rows.select("t", P.text_number(F.col("v")).alias("x")).collect())


def test_rounded_and_ratio(spark):
    row = spark.createDataFrame([(2.345, -2.5, 0.0)], "a double, b double, z double").select(P.rounded("a", 2).alias("a"), P.rounded("b").alias("b"), P.ratio(F.col("a"), F.col("z")).alias("r")).first()
    assert row["a"] == 2.35 and row["b"] == -3.0 and row["r"] is None


@pytest.mark.parametrize("a, b, fit", [("integer", "float", 0.95), ("string", "id_like", 1.0), ("time_of_day", "date", 0.8), ("duration", "number", 0.85), ("boolean", "date", 0.4), ("", "date", 0.7), ("empty", "date", 0.5)])
def test_compatibility(spark, a, b, fit):
    assert spark.range(1).select(compatibility(F.lit(a), F.lit(b)).alias("x")).first()["x"] == fit


def test_units(spark):
    assert units.unit_of_name("dur_hrs", ["minutes", "hours"]) == "hours"
    assert units.unit_name(" HRS ") == "hours" and units.unit_name("parsec") is None
    assert units.unit_of_values(4, 8, 12, "minutes", ["hours", "minutes"]) == "hours"
    assert units.unit_of_samples(["-0.5", "7.25", "x", None, "inf"], "minutes", ["hours", "minutes"]) == "hours"
    assert units.unit_of_samples(["-0.5", "7"], "minutes", ["hours", "minutes"]) is None and units.unit_of_samples([], "minutes", ["hours"]) is None
    assert units.conversion("dur_hrs", "minutes", ["hours", "minutes"])["needed"]
    assert not units.conversion("duration_minutes", "minutes", ["hours", "minutes"])["needed"]
    row = spark.range(1).select(units.convert(F.lit(212), "fahrenheit", "celsius").alias("c"), units.convert(F.lit(90), "minutes", "hours").alias("h"), units.convert(F.lit(1), "m", "kg").alias("same")).first()
    assert (row["c"], row["h"], row["same"]) == (100.0, 1.5, 1.0)


@pytest.mark.parametrize("value, iso", [("01/06/2024", "2024-06-01"), ("31/31/2024", "31/31/2024"), ("x", "x")])
def test_iso_date(spark, value, iso):
    assert one(spark, lambda v: units.iso_date(v, "DD/MM/YYYY"), value) == iso
