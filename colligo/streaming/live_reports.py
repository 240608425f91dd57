"""Reports on streams: rows of shifts, each given out once its day is over.

A shift waits in the state until its day is closed, and what was recorded on a day is one row of measures
for each employee, so state grows with the employees of two or three days and not with the stream.  A row
that comes after its day was closed is dropped, as watermarks have it; Spark counts such rows.  The pay
table is a plain table.  Rows have no order; all else is as in the reports of tables, which share the code.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import reports as R
from ..plans.reports import P, Registry, Tables


def _day_end(day: str) -> Column:
    return F.date_add(F.col(day), 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")


def with_activity(shifts: DataFrame, done: DataFrame, measures: list[Column], late: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``shifts`` (employee_id, day, ...) with ``measures`` of what ``done`` (employee_id, day, ...) has on their day.

    Both are streams, or both tables.  A day is closed once both have rows of a day after the next ``late``.
    A shift without anything recorded, or whose day or employee is null, is there with nulls.
    """
    # An event counts as of its day's end: a whole day more has to pass until the day is surely over.
    wait = f"1 day {late}"
    whole = F.col("day").isNotNull() & F.col("employee_id").isNotNull()
    done = done.where(whole).withColumn("day_end", _day_end("day")).withWatermark("day_end", wait)
    done = done.groupBy("employee_id", "day_end", *by).agg(*measures).drop(*by)
    # Null keys have no partner and no time to wait for.
    rest = shifts.where(~whole)
    timed = shifts.where(whole).withColumn("day_end", _day_end("day")).withWatermark("day_end", wait)
    return timed.join(done, ["employee_id", "day_end"], "left").drop("day_end").unionByName(rest, allowMissingColumns=True)


def _done(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    return (t[P] if rows is None else rows).withColumns({"employee_id": F.col("staff_id"), "day": R.moment().cast("date")})


def attendance_discrepancies(t: Tables, p: dict[str, Any], late: str) -> DataFrame:
    done = _done(t, t[P].where(R._between(R._day("performed_datetime"), p)))
    shifts = R._shifts(t, p).withColumn("day", R._day("shift_date"))
    return R.attendance_rows(with_activity(shifts, done, R.activity_measures(), late))


def gross_profit_per_shift(t: Tables, p: dict[str, Any], late: str) -> DataFrame:
    done = _done(t, R._procedures(t, p, "department"))
    return R.profit_rows(with_activity(R.paid_shifts(t, p), done, R.earned_measures(), late, ["location"]))


#: Reports that a stream of shifts can give: the first two wait for a stream of procedures, the others for nothing.
LIVE: dict[str, Callable[[Tables, dict[str, Any], str], DataFrame]] = {
    "attendance_discrepancies": attendance_discrepancies,
    "gross_profit_per_shift": gross_profit_per_shift,
    "cost_per_shift": lambda t, p, late: R.cost_rows(t, p),
    "lateness_flags": lambda t, p, late: R.lateness_rows(t, p),
}


def live(name: str, tables: Tables, parameters: dict[str, Any] | None = None, late: str = "1 hour") -> DataFrame:
    """A report whose shifts and procedures are streams, to be written in append mode; its parameters are bound as ever."""
    if name not in LIVE:
        raise ValueError(f"report {name} is not given on streams; {', '.join(LIVE)} are")
    return LIVE[name](tables, Registry().get(name).bind(parameters or {}), late)
