"""What is kept between runs, columns of unknown formats, and joins by bins, against plain definitions."""

import datetime
import random

import numpy as np
import pytest
import xxhash
from colligo.functions import dates, embedding, json_columns
from colligo.operators import interval_join
from colligo.operators.field_index import FieldIndex
from colligo.operators.ground_truth import GroundTruth
from colligo.sources.catalog import Catalog
from pyspark.sql import functions as F


def test_ground_truth(spark, tmp_path):
    truth = GroundTruth(Catalog(spark, f"{tmp_path}/truth"))
    assert truth.entries() is None and truth.newest().collect() == [] and truth.counts().collect() == []
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = lambda *r: spark.createDataFrame(r, "item_id string, vertical string, document_type string, labelled_at timestamp, vector array<double>")
    truth.add(rows(("a", "v", "x", at(1), [1.0]), ("b", "v", "x", at(3), [2.0]), ("c", None, "y", at(3), None), (None, "v", "x", at(9), None)))
    truth.add(rows(("a", "v", "z", at(5), [3.0]), ("b", "v", "older, so it does not count", at(2), [9.0])))
    listed = lambda t, **k: [(r["item_id"], r["document_type"]) for r in t.newest(**k).collect()]
    assert listed(truth) == [("a", "z"), ("b", "x"), ("c", "y")] and listed(truth, limit=1) == [("a", "z")]
    assert listed(truth, where=F.col("vertical") == "v") == [("a", "z"), ("b", "x")]
    truth.remove(spark.createDataFrame([("a",)], "item_id string"))
    again = GroundTruth(Catalog(spark, f"{tmp_path}/truth"))
    assert listed(again) == [("b", "x"), ("c", "y")] and [r["vector"] for r in again.current().where("item_id = 'b'").collect()] == [[2.0]]
    assert sorted((r["vertical"] or "", r["document_type"], r["tables"]) for r in again.counts().collect()) == [("", "y", 1), ("v", "x", 1)]


def test_field_index(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/index")
    index = FieldIndex(catalog, embedding.HashedNgrams(16))
    rows = lambda *r: spark.createDataFrame(r, "vertical string, document_type string, field_name string, text string")
    assert index.current() is None
    assert index.index(rows(("v", "t", "a", "x"), ("v", "t", "a", "x"), ("v", "t", "b", "y"), (None, "t", "c", None))) == 3
    versions = catalog.versions()
    assert index.index(rows(("v", "t", "a", "x"), (None, "t", "c", None))) == 0 and catalog.versions() == versions
    assert index.index(rows(("v", "t", "a", "changed"), ("v", "u", "d", "z"))) == 2
    text = lambda: sorted((r["field_name"], r["text"] or "", len(r["vector"])) for r in FieldIndex(catalog).current().collect())
    assert text() == [("a", "changed", 16), ("b", "y", 16), ("c", "", 16), ("d", "z", 16)]
    index.remove("u")
    assert [x[0] for x in text()] == ["a", "b", "c"]
    assert index.index(rows(("v", "t", "b", "y")), force=True) == 1 and text() == [("b", "y", 16)]


PATTERNS = {"YYYY-MM-DD": "%Y-%m-%d", "YYYY/MM/DD": "%Y/%m/%d", "DD/MM/YYYY": "%d/%m/%Y", "MM/DD/YYYY": "%m/%d/%Y", "DD-MM-YYYY": "%d-%m-%Y", "MM-DD-YYYY": "%m-%d-%Y", "DD.MM.YYYY": "%d.%m.%Y", "YYYYMMDD": "%Y%m%d"}


def test_date_formats_against_python(spark):
    rng = random.Random(2)
    mark = lambda: rng.choice("-/.")
    values = [None, "", "  ", "x", "2024-02-30", "29/02/2023", "29/02/2024", "0000-01-01", "1900-02-29", " 1-2-2024 ", "20241301", "20241231", "1/2/24", "2024-1/2", "2024.01.02", "12-13-2024", "13-12-2024"]
    for _ in range(600):
        a, b, y = rng.randrange(33), rng.randrange(33), rng.randrange(1, 9999)
        m = mark()
        values.append(rng.choice([f"{y:04}{m}{a:02}{m}{b}", f"{a}{m}{b:02}{m}{y:04}", f"{a:02}{m}{b:02}{mark()}{y:04}", f"{y:04}{a:02}{b:02}"]))

    def fits(v, pattern):
        try:
            day = datetime.datetime.strptime(v, pattern).date()
        except ValueError:
            return None
        return day if pattern != "%Y%m%d" or len(v) == 8 else None

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", dates.allowed(F.col("v")).alias("mask"), *[dates.read(F.col("v"), n).alias(n) for n in PATTERNS]).collect()
    for r in rows:
        text = (r["v"] or "").strip(" ")
        want = {n: fits(text, p) for n, p in PATTERNS.items()}
        assert r["mask"] == (sum(1 << i for i, n in enumerate(dates.FORMATS) if want[n]) if text else None), r["v"]
        assert {n: r[n] for n in PATTERNS} == want, r["v"]


def test_column_formats(spark):
    columns = {"dmy": ["1/2/2024", "13/2/2024", None], "mdy": ["1/2/2024", "2/13/2024", ""], "open": ["1/2/2024", "3/4/2024", None], "none": ["1/2/2024", "2024-01-02", "x"], "empty": [None, "", " "], "a.b": ["20240102"] * 3}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` string" for c in columns))
    got = {r["column_name"]: tuple(r)[1:] for r in dates.column_formats(df, list(columns)).collect()}
    assert got == {
        "dmy": ("DD/MM/YYYY", ["DD/MM/YYYY"], 2, 0), "mdy": ("MM/DD/YYYY", ["MM/DD/YYYY"], 2, 0), "open": ("DD/MM/YYYY", ["DD/MM/YYYY", "MM/DD/YYYY"], 2, 0),
        "none": (None, [], 3, 1), "empty": (None, [], 0, 0), "a.b": ("YYYYMMDD", ["YYYYMMDD"], 3, 0),
    }
    assert dates.column_formats(df, []).collect() == []


def test_json_columns(spark):
    texts = ['{"a": 1, "b": {"c": [1, 2]}}', '{"a": 2.5, "d": "x"}', "{bad", None, '{"b": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    assert json_columns.schema_of(df, "j").startswith("STRUCT<a: D")
    rows = json_columns.decoded(df, "j", "x").withColumn("bad", json_columns.malformed("j")).orderBy("id").collect()
    assert [r["bad"] for r in rows] == [False, False, True, False, False] and rows[2]["x"] is None and rows[3]["x"] is None
    assert float(rows[1]["x"]["a"]) == 2.5 and rows[0]["x"]["b"]["c"] == [1, 2] and rows[0]["x"]["d"] is None
    back = json_columns.decoded(json_columns.decoded(df, "j", "x").withColumn("j", json_columns.encoded(F.col("x"))), "j", "y", "STRUCT<a: DOUBLE, b: STRUCT<c: ARRAY<BIGINT>>, d: STRING>")
    assert [r["y"] and (r["y"]["a"], r["y"]["d"]) for r in back.orderBy("id").collect()] == [(1.0, None), (2.5, "x"), None, None, (None, None)]
    none = json_columns.decoded(df.where("id = 2"), "j")
    assert json_columns.schema_of(df.where("id = 2"), "j") is None and none.first()["j"] is None


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_intervals_against_all_pairs(spark, width):
    """One key has most rows; ends are included, nulls meet nothing, repeated intervals count as often as they occur."""
    rng = random.Random(width)
    intervals = [(rng.choice("aaab"), s, s + rng.randrange(-3, 40)) for s in (rng.randrange(-100, 100) for _ in range(60))] + [("a", 5, 5), ("a", 5, 5), ("z", 0, 9), (None, 0, 9), ("a", None, 9), ("a", 0, None)]
    points = [(rng.choice("aaac"), rng.randrange(-120, 140), i) for i in range(200)] + [(None, 1, 900), ("a", None, 901), ("a", 5, 902)]
    left = spark.createDataFrame(intervals, "k string, low int, high int")
    right = spark.createDataFrame(points, "k string, at int, id int")
    held = [(i, p) for i in intervals for p in points if None not in (*i, *p) and i[0] == p[0] and i[1] <= p[1] <= i[2]]
    args = (left, right, ["k"], F.col("low"), F.col("high"), F.col("at"), width)
    assert sorted(map(tuple, interval_join.inside(*args).collect())) == sorted((*i, p[1], p[2]) for i, p in held)
    got = {tuple(r)[:3]: r["n"] for r in interval_join.count_inside(*args, ["k", "low", "high"]).collect()}
    assert got == {i: sum(j == i for j, _ in held) for i in intervals}


def test_overnight(spark):
    hour = 3_600_000_000
    row = spark.createDataFrame([(22, 6), (8, 16), (8, 8)], "s long, e long").select(interval_join.overnight(F.col("s") * hour, F.col("e") * hour).alias("x")).collect()
    assert [r["x"] // hour for r in row] == [30, 16, 32]


def test_hashed_ngrams_against_a_loop(spark):
    def plain(text):
        v, t = np.zeros(64), f" {text.lower()} " if text else ""
        for n in (2, 3, 4):
            for i in range(len(t) - n + 1):
                h = xxhash.xxh3_64_intdigest(t[i : i + n])
                v[h % 64] += 1 if h >> 63 else -1
        return (v / np.linalg.norm(v) if v.any() else v).astype(np.float32)

    texts = [None, "", "a", "Employee ID", "é ü 漢字 😀", "x" * 500, "Employee ID"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = {r["i"]: r["v"] for r in embedding.with_vectors(df, "t", embedding.HashedNgrams(64), "v").collect()}
    assert all(np.allclose(got[i], plain(t), atol=1e-7) for i, t in enumerate(texts))


def test_model_batches_span_arrow_batches(spark, tmp_path):
    """The model sees full batches of its own size, prefixed and cut texts, and no blank ones; rows keep their order."""
    seen = str(tmp_path / "seen")

    def load():
        def model(texts):
            with open(seen, "a") as f:
                f.write(f"{len(texts)} {texts[0]}\n")
            return [[float(len(t)), float(t.split(":")[0] == "query")] for t in texts]

        return model

    texts = [None, "", " "] + [f"text-{'x' * i}" for i in range(47)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = embedding.with_vectors(df, "t", embedding.ModelBatches(load, 20, longest=30).for_queries(), "v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["v"] for r in got] == [None] * 3 + [[float(len("query: ") + min(len(t), 30)), 1.0] for t in texts[3:]]
    assert [line.split()[0] for line in open(seen)] == ["20", "20", "7"] and open(seen).read().startswith("20 query: text-")


def test_counting_makes_no_pairs(spark):
    """Many intervals that hold many points of one key: no join holds intervals against points."""
    intervals = spark.range(400).select(F.lit("a").alias("k"), F.lit(0).alias("low"), (F.col("id") + 1000).cast("int").alias("high"), F.col("id").alias("i"))
    points = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("at"))
    counted = interval_join.count_inside(intervals, points, ["k"], F.col("low"), F.col("high"), F.col("at"), 2000, ["k", "i"])
    assert {r["n"] for r in counted.collect()} == {1000}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "_low" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_each_date_is_read_once(spark):
    """A column's values are grouped before they are held against the formats."""
    df = spark.createDataFrame([("1/2/2024",)] * 5 + [("x",)] * 2 + [(None,)], "d string")
    found = dates.column_formats(df, ["d"])
    assert tuple(found.first()) == ("d", None, [], 7, 2)
    above, grouped = found._jdf.queryExecution().optimizedPlan().toString().rsplit("Aggregate [column_name", 1)
    assert grouped.split("]")[0].count("value#") == 1 and "RLIKE" not in grouped.split("\n", 1)[1]
