import pytest
from colligo.operators import knowledge
from colligo.plans.classify import classify, classify_by_examples, ingest_all
from colligo.plans.reports import C, P, Parameter, Registry, S
from colligo.sources.tables import Store, read_csv, renamed, table_name


@pytest.fixture(scope="module")
def tables(spark):
    store = Store(spark)
    shifts = [
        ("E1", "Ann", "2024-06-01", "08:00", "16:00", "08:10", "16:00", 480, "D1", "day"),
        ("E1", "Ann", "2024-06-02", "08:00", "16:00", "07:20", "16:40", 480, "D1", "day"),
        ("E2", "Bo'b", "2024-06-01", "14:00", "22:00", "14:00", "21:40", None, "D2", None),
        ("E3", None, "2024-06-01", "23:00", "07:00", None, None, 480, "D2", "night"),
    ]
    store.load(spark.createDataFrame(shifts, "employee_id string, employee_name string, shift_date string, shift_start string, shift_end string, actual_start string, actual_end string, duration_minutes int, department_code string, shift_type string"), S)
    store.load(spark.createDataFrame([("E1", "Ann", "salaried", 5000.0, None, 40.0, "Doctor"), ("E2", "Bo'b", "contractor", None, 60.0, None, "Nurse")], "employee_id string, employee_name string, employment_type string, gross_salary double, hourly_rate double, effective_hourly_cost double, position string"), C)
    procedures = [(f"P{i}", "E1", "B1", "scan", f"2024-06-01 0{8 + i % 2}:30:00", "D1", 100.0) for i in range(3)] + [("P9", "E2", "B1", "scan", "2024-06-01 15:00:00", "D2", None)]
    store.load(spark.createDataFrame(procedures, "procedure_id string, staff_id string, billing_code string, procedure_description string, performed_datetime string, location string, price double"), P)
    return store.tables()


def run(tables, name, **parameters):
    result = Registry().run(name, tables, parameters)
    assert result.success, result.error
    return [r.asDict() for r in result.data.collect()]


def test_cost_per_shift(tables):
    rows = {(r["employee_id"], r["shift_date"]): r for r in run(tables, "cost_per_shift")}
    assert rows["E1", "2024-06-01"]["shift_cost"] == 320.0 and rows["E2", "2024-06-01"]["shift_cost"] == 480.0 and rows["E3", "2024-06-01"]["shift_cost"] == 0.0
    assert "8.0 hours × $40.0/hour (effective rate" in rows["E1", "2024-06-01"]["evidence"]


def test_parameters_are_bound(tables):
    assert [r["employee_id"] for r in run(tables, "cost_per_shift", department="D1", start_date="2024-06-02")] == ["E1"]
    assert run(tables, "cost_per_shift", department="x' OR '1'='1") == [] and len(run(tables, "cost_per_shift", nonsense=1)) == 4


def test_lateness(tables):
    rows = {(r["employee_id"], r["shift_date"]): r for r in run(tables, "lateness_flags")}
    assert [rows[k]["compliance_flag"] for k in (("E1", "2024-06-01"), ("E1", "2024-06-02"), ("E2", "2024-06-01"))] == ["FLAGGED_LATE", "FLAGGED_TOO_EARLY", "FLAGGED_EARLY_DEPARTURE"]
    assert run(tables, "lateness_flags", early_threshold_minutes=-3)[0]["minutes_late"] == 10 and ("E3", "2024-06-01") not in rows


def test_attendance_and_profit(tables):
    status = {(r["employee_id"], r["shift_date"]): (r["activity_status"], r["procedure_count"]) for r in run(tables, "attendance_discrepancies")}
    assert status["E1", "2024-06-01"] == ("HAS_ACTIVITY", 3) and status["E1", "2024-06-02"] == ("NO_ACTIVITY_RECORDED", 0)
    profit = {(r["employee_id"], r["shift_date"]): r for r in run(tables, "gross_profit_per_shift")}
    assert profit["E1", "2024-06-01"]["gross_profit"] == -20.0 and profit["E1", "2024-06-01"]["profit_margin_pct"] == -6.7 and profit["E2", "2024-06-01"]["profit_margin_pct"] == 0.0


def test_performance_and_cost(tables):
    rows = run(tables, "doctor_performance_by_procedure")
    assert [(r["employee_id"], r["procedures_performed"], r["avg_duration_hours"], r["doctors_performing"]) for r in rows] == [("E1", 3, 2.67, 2)]
    cost = run(tables, "avg_cost_per_procedure")[0]
    assert cost["procedure_count"] == 4 and cost["avg_staff_cost"] == 22.5 and cost["avg_revenue"] == 75.0


def test_summary_and_patterns(tables):
    assert sum(r["total_shifts"] for r in run(tables, "shift_summary")) == 4
    rows = run(tables, "shift_patterns")
    assert sum(r["total_shifts"] for r in rows) == 4 and {r["late_arrivals"] for r in rows} == {0, 1}


def test_run_never_raises(tables):
    registry = Registry()
    assert "unknown" in registry.run("nope", tables).error
    assert "not loaded" in registry.run("cost_per_shift", {S: tables[S]}).error
    assert registry.run("cost_per_shift", tables, {"start_date": "soon"}).error.startswith("ValueError")
    assert f"{S}.duration_minutes" in registry.get("cost_per_shift").missing({**tables, S: tables[S].drop("duration_minutes")})
    assert set(registry.run_all({P: tables[P], C: tables[C]})) == {"avg_cost_per_procedure"}
    with pytest.raises(ValueError):
        Parameter("x", required=True).read(None)


def test_csv_and_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n\n007,1\n,2\n")
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert [r["code"] for r in df.orderBy("_row").collect()] == ["007", None]
    store = Store(spark, str(tmp_path / "store"))
    store.load(df, "Lab Results", {"code": "test_code", "missing": "x", "n": ""})
    store.load(df, "Lab Results", {"code": "test_code"}, replace=False)
    assert store.has("lab results") and store.tables()["lab_results"].count() == 4 and "test_code" in store.tables()["lab_results"].columns
    assert store.sql("select count(*) as n from lab_results where test_code = :c", c="007").first()["n"] == 2
    assert store.drop("lab results") and not store.has("lab results") and table_name("1 a-b") == "t_1_a_b"
    assert renamed(df, {"code": "n"}).columns == df.columns


def test_classify(spark):
    rows = [(f"E{i:03d}", "2024-01-0%d" % (1 + i % 9), "08:00", "16:00", "8") for i in range(12)]
    c = classify(spark.createDataFrame(rows, "emp_id string, shift_date string, start_time string, end_time string, dur_hrs string"))
    assert c.document_type == "employee_shifts"
    assert c.mappings["emp_id"] == "employee_id" and c.mappings["start_time"] == "shift_start"
    assert c.conversions == {"duration_minutes": ("hours", "minutes")}


def test_unit_by_values(spark):
    rows = [(f"E{i:03d}", "2024-01-0%d" % (1 + i % 9), "08:00", "16:00", "7.5") for i in range(12)]
    c = classify(spark.createDataFrame(rows, "emp_id string, shift_date string, start_time string, end_time string, duration string"))
    assert c.document_type == "employee_shifts" and c.conversions == ({"duration_minutes": ("hours", "minutes")} if c.mappings.get("duration") == "duration_minutes" else {})


def test_classify_by_examples(spark):
    shifts = spark.createDataFrame([("E1", "2024-01-01", "08:00")], "emp string, day string, start string")
    pay = spark.createDataFrame([("E1", 10.5)], "emp string, rate double")
    examples, known, told = ingest_all([(shifts, "a", "employee_shifts", {"emp": "employee_id", "start": "shift_start"}), (pay, "b", "employee_compensation", {"none": "x"}), (pay, "c", "employee_compensation", {"emp": "employee_id"})])
    assert [e is None for _, e in told] == [True, False, True] and examples.count() == 2
    best, columns = classify_by_examples(shifts, examples, knowledge.upsert(None, known), k=1)
    assert tuple(best.first()) == ("employee_shifts", 1.0, "medical")
    assert {r["source_column"]: (r["target_field"], r["confidence"], r["origin"]) for r in columns.collect() if r["source_column"] != "day"} == {"emp": ("employee_id", 1.0, "similar_tables"), "start": ("shift_start", 1.0, "similar_tables")}


def test_export_and_log(spark, tables, tmp_path):
    from colligo.plans.reports import export, log

    results = Registry().run_all({P: tables[P], C: tables[C]})
    paths = export(results, str(tmp_path))
    assert len(paths) == 1 and spark.read.csv(paths[0], header=True).count() == 1
    assert log(results)[0]["rows"] == 1 and log(results)[0]["error"] is None


def test_profit_is_sorted_before_details_are_repeated(spark, tables):
    """Shifts of one employee, day, kind and department are sorted as one row; each has its own row in the report, in its order."""
    more = {**tables, S: tables[S].unionByName(tables[S].where("employee_id = 'E1'")).unionByName(tables[S].where("employee_id = 'E2'").selectExpr("* except (duration_minutes)", "60 AS duration_minutes"))}
    data = Registry().get("gross_profit_per_shift").build(more, {})
    rows = data.collect()
    assert len(rows) == 7 and sorted(r["shift_cost"] for r in rows if r["employee_id"] == "E2") == [60.0, 480.0]
    assert sum(r["procedures_performed"] == 3 and r["evidence"].count("B1 ($100.0)") == 3 for r in rows) == 2
    assert [r["shift_date"] for r in rows if r["employee_id"] == "E1"] == sorted(r["shift_date"] for r in rows if r["employee_id"] == "E1")
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Sort [")


def test_profit_counts_shifts_until_they_are_sorted(spark, tables):
    """Shifts of the same hours are one with their number until the report is sorted, without a window over all shifts; every shift and procedure is in the rows and texts."""
    done = [("P10", "E1", "A2", "x", "2024-06-01 09:00:00", "D9", 50.5), ("P11", "E1", "A2", "x", "2024-06-01 10:00:00", "D9", 50.5), ("P12", "E1", "A1", "x", "2024-06-01 11:00:00", None, -0.0), ("P13", None, "A1", "x", None, "D9", 1.0)]
    first = tables[S].where("employee_id = 'E1' and shift_date = '2024-06-01'")
    shifts = tables[S].unionByName(first).unionByName(first.selectExpr("* except (duration_minutes)", "CAST(NULL AS INT) AS duration_minutes")).unionByName(first.selectExpr("* except (duration_minutes)", "60 AS duration_minutes"))
    shifts = shifts.unionByName(first.selectExpr("* except (employee_id, shift_date)", "CAST(NULL AS STRING) AS employee_id", "'soon' AS shift_date"))
    data = Registry().get("gross_profit_per_shift").build({**tables, S: shifts, P: tables[P].unionByName(spark.createDataFrame(done, tables[P].schema))}, {})
    plan = data._jdf.queryExecution().executedPlan().toString()
    rows = data.collect()
    of_day = [r for r in rows if r["employee_id"] == "E1" and r["shift_date"] == "2024-06-01"]
    texts = {3: (300.0, "B1 ($100.0); B1 ($100.0); B1 ($100.0)"), 2: (101.0, "A2 ($50.5); A2 ($50.5)"), 1: (0.0, "A1 ($-0.0)")}
    assert sorted((r["procedures_performed"], r["shift_hours"]) for r in of_day) == [(n, h) for n in (1, 2, 3) for h in (1.0, 8.0, 8.0, 8.0)]
    assert all(r["procedure_revenue"] == texts[r["procedures_performed"]][0] and f"Procedures: {texts[r['procedures_performed']][1]}. Gross" in r["evidence"] for r in of_day)
    assert [(r["employee_name"], r["procedures_performed"], r["shift_cost"]) for r in rows if r["employee_id"] is None] == [(None, 0, 0.0)] and len(rows) == 12 + 4
    assert "Window" not in plan and plan.index("array_repeat") < plan.index("Exchange rangepartitioning")
