import random

import pytest
from colligo.operators import profiler
from pyspark.sql import functions as F


def kinds(spark, values, name="x"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, `{name}` string")
    return profiler.profile(df, F.col("i"), [name]).first()


@pytest.mark.parametrize(
    "values, name, kind",
    [
        (["0", "1"] * 10, "x", "integer"), (["5.0", "6.0", "7.0"] * 7, "x", "integer"), (["1.5", "2.5", "3.25"] * 7, "x", "float"),
        (["08:00", "09:30", "17:15"], "x", "time_of_day"), (["90m", "2h", "30m"], "x", "duration"), (["yes", "no"] * 10, "x", "boolean"),
        (["2024-01-02 08:00", "2024-01-03 09:00"], "x", "datetime"), (["2024-01-02", "2024-01-03"], "x", "date"),
        ([f"EMP{i:04d}" for i in range(30)], "x", "id_like"), (["red", "blue"] * 40, "x", "categorical"), (["", None, "n/a"], "x", "empty"),
        ([f"{i:05d}" for i in range(30)], "x", "integer"), ([f"this is a long sentence about the number {i}" for i in range(30)], "x", "free_text"),
    ],
)
def test_detected_type(spark, values, name, kind):
    assert kinds(spark, values, name)["detected_type"] == kind


def test_statistics(spark):
    p = kinds(spark, ["a", None, "b", "a", "N/A"])
    assert (p["non_null_count"], p["null_count"], p["unique_count"], p["max_strlen"]) == (3, 2, 2, 1)
    assert p["sample_values"] == ["a", "b"] and abs(p["unique_ratio"] - 2 / 3) < 1e-12


def test_sample_is_the_first_rows(spark):
    df = spark.range(5000).repartition(7).select(F.col("id"), (F.col("id") % 3000).cast("string").alias("v"))
    p = profiler.profile(df, F.col("id"), ["v"], size=100).first()
    assert p["unique_count"] == 100 and p["non_null_count"] == 5000 and p["sample_values"][:3] == ["0", "1", "2"] and p["numeric_max"] == 99.0


def test_text(spark):
    d = profiler.described(profiler.profile(spark.createDataFrame([(1, "E001"), (2, "E002")], "i int, emp string"), F.col("i"), ["emp"]))
    assert d.first()["text"].startswith("emp (id_like); high cardinality; examples: E001, E002")
    assert profiler.table_text(d).first()["text"].startswith("Table with 1 columns: emp")


def test_cells_are_narrowed_before_they_are_shuffled(spark):
    """The first values of each column by row and value, whatever the cells' order; what is sent does not grow with them."""
    rng = random.Random(4)
    cells = [(rng.choice("ab"), i % 3, f"c{i % 3}", rng.randrange(400), rng.choice([None, "", "x", f"v{rng.randrange(50)}"])) for i in range(3000)] + [("n", 0, "empty", 1, None)]
    df = spark.createDataFrame(cells, "file string, column_position int, column_name string, row long, value string").repartition(3)
    got = profiler.sample_cells(df, ["file"], 20).collect()
    for file, at in {c[:2] for c in cells}:
        own = sorted((c[3], c[4]) for c in cells if c[:2] == (file, at) and c[4])
        rows = sorted((r["rank"], r["value"]) for r in got if (r["file"], r["column_position"]) == (file, at) and r["rank"])
        assert rows == [(i + 1, v) for i, (_, v) in enumerate(own[:20])]
        assert sum(r["filled"] or 0 for r in got if (r["file"], r["column_position"]) == (file, at)) == len(own)
        assert sum(r["missing"] or 0 for r in got if (r["file"], r["column_position"]) == (file, at)) == sum(c[:2] == (file, at) and not c[4] for c in cells)
    plan = profiler.sample_cells(df, ["file"], 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Window ") < plan.index("MapInArrow")
