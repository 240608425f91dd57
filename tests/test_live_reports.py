"""Reports and sessions on streams of files against the same on tables."""

import os
import random

import pytest
from colligo.plans.reports import C, P, Registry, S
from colligo.streaming import kpi
from colligo.streaming.live_reports import LIVE, live

SHIFTS = "employee_id string, shift_date string, shift_start string, shift_end string, department_code string, shift_type string, detected_shift_type string, employee_name string, duration_minutes int, actual_start string, actual_end string"
PROCEDURES = "procedure_id string, staff_id string, billing_code string, procedure_description string, performed_datetime string, location string, price double"
PAY = "employee_id string, employee_name string, employment_type string, hourly_rate double, effective_hourly_cost double, gross_salary double, position string"
DAYS = 8


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def written(spark, folder, slices, schema):
    """Files of a folder in order of time; the stream takes one for each batch."""
    os.makedirs(folder)
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-parts/{i}")
        part = next(f for f in os.listdir(f"{folder}-parts/{i}") if f.endswith(".parquet"))
        os.rename(f"{folder}-parts/{i}/{part}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.schema(schema).parquet(folder)


def given_out(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return stream.sparkSession.table(name), query.recentProgress


def key(rows):
    return sorted(map(repr, (r.asDict() for r in rows)))


def make(spark, tmp_path):
    rng = random.Random(8)
    shifts, done = [], []
    for d in range(1, DAYS + 1):
        day = f"2024-03-{d:02d}"
        # What is recorded on the day before comes late, but before the day is closed.
        before = f"2024-03-{d - 1:02d}"
        shifts.append([(f"E{e}", day, "08:00", "16:30", f"D{e % 2}", None, rng.choice(["MORNING", None]), f"N{e}", rng.choice([480, None]), rng.choice(["08:10", "07:00", None, ""]), "16:00") for e in range(12)])
        at = [(e, rng.choice([day, before] if d > 1 else [day])) for e in rng.choices(range(9), k=30)]
        done.append([(f"p{d}{i}", f"E{e}", f"B{rng.randrange(3)}", "x", f"{on} {rng.randrange(24):02d}:15:00", rng.choice(["D0", "D1", None]), rng.choice([10.25, None])) for i, (e, on) in enumerate(at)])
    shifts[0] += [("E1", None, "08:00", "16:00", "D1", "EVENING", None, None, 60, None, None), (None, "2024-03-01", None, None, None, None, None, None, None, "09:00", None), shifts[0][0]]
    done[0] += [("n", None, "B0", "x", "2024-03-01 09:15:00", "D0", 1.0), ("m", "E1", "B0", "x", "soon", "D0", 1.0)]
    # Rows far behind close all days before.
    shifts.append([("LAST", "2024-06-01", "08:00", "16:00", "D0", None, None, None, None, None, None)])
    done.append([("z", "LAST", "B0", "x", "2024-06-01 09:00:00", "D0", 1.0)])
    pay = spark.createDataFrame([(f"E{e}", f"N{e}", ["salaried", "contractor", None][e % 3], 10.0 + e, None, 100.0, "R") for e in range(7)], PAY)
    return written(spark, str(tmp_path / "s"), shifts, SHIFTS), written(spark, str(tmp_path / "p"), done, PROCEDURES), pay


def test_reports_on_streams(spark, tmp_path, few_partitions):
    (s, s_table), (p, p_table), pay = make(spark, tmp_path)
    for name, parameters in [("attendance_discrepancies", {}), ("gross_profit_per_shift", {"start_date": "2024-03-02"}), ("cost_per_shift", {"department": "D1"}), ("lateness_flags", {})]:
        rows, progress = given_out(live(name, {S: s, P: p, C: pay}, parameters, "2 hours"), tmp_path, name)
        report = Registry().get(name)
        wanted = report.build({S: s_table, P: p_table, C: pay}, report.bind(parameters))
        assert rows.columns == wanted.columns
        # The last day is never closed.
        rows, wanted = ([r for r in x.collect() if r["employee_id"] != "LAST"] for x in (rows, wanted))
        assert len(wanted) > 20 and key(rows) == key(wanted), name
        kept = [sum(o["numRowsTotal"] for o in json_of(x)["stateOperators"]) for x in progress]
        if name in ("attendance_discrepancies", "gross_profit_per_shift"):
            # Three days' shifts, and procedures by employee and place, at most; nothing stays but the last day.
            assert 0 < max(kept) <= 3 * (14 + 9 * 3) and kept[-1] <= 3, kept
        else:
            assert not any(kept)
    assert set(LIVE) == {"attendance_discrepancies", "gross_profit_per_shift", "cost_per_shift", "lateness_flags"}
    with pytest.raises(ValueError, match="not given on streams"):
        live("shift_summary", {S: s, P: p, C: pay})


def json_of(progress):
    import json

    return progress if isinstance(progress, dict) else json.loads(progress.json)


def test_live_report_of_tables(spark, tmp_path):
    """Tables may stand in for streams; empty ones give no rows."""
    (_, s), (_, p), pay = make(spark, tmp_path)
    report = Registry().get("attendance_discrepancies")
    assert key(live(report.name, {S: s, P: p, C: pay}).collect()) == key(report.build({S: s, P: p, C: pay}, report.bind({})).collect())
    assert live(report.name, {S: s.limit(0), P: p.limit(0), C: pay}).count() == 0


def test_sessions_on_a_stream(spark, tmp_path, few_partitions):
    rng, schema = random.Random(9), "event_id int, ts timestamp_ntz, user_id int, event_type string, value double"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    slices = [[(i, start + timedelta(hours=3 * k, minutes=rng.randrange(180)), rng.randrange(4), "a", 1.0) for i in range(20)] for k in range(6)]
    slices.append([(99, start + timedelta(days=9), 99, "a", 1.0)])
    stream, table = written(spark, str(tmp_path / "e"), slices, schema)
    rows, _ = given_out(kpi.sessions(stream, "20 minutes", "4 hours"), tmp_path, "session_rows")
    wanted = kpi.sessions(table, "20 minutes", "4 hours").where("user_id <> 99")
    assert key(rows.collect()) == key(wanted.collect()) and wanted.where("n > 1").count() > 5
