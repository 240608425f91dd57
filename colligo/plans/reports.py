"""Reports: named, parameterised plans over loaded tables.

S are employee_shifts (enriched), C employee_compensation and P staff_clinical_procedures.  Every
parameter is a bound value, never text of a query; one that is left out leaves its filter out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from time import perf_counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import minutes_of_day, ratio, rounded, text_number, time_of_day
from ..operators.interval_join import count_inside

Tables = dict[str, DataFrame]
S, C, P = "employee_shifts", "employee_compensation", "staff_clinical_procedures"
#: Order of shift types in every report (fixed values).
SHIFT_TYPES = ["MORNING", "MID_DAY", "AFTERNOON", "EVENING", "NIGHT"]
#: Hours of a shift without a duration, and of a procedure.
SHIFT_HOURS, PROCEDURE_HOURS = 8.0, 0.5
#: Minutes before the end that are an early departure, and after it overtime.
LEFT_EARLY, OVERTIME = -15, 30


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str = "string"  # string, integer, float, date, datetime, boolean
    default: Any = None
    required: bool = False

    def read(self, value: Any) -> Any:
        """The value in its type; raises ValueError if it has none or lacks."""
        value = self.default if value is None else value
        if value is None:
            if self.required:
                raise ValueError(f"parameter {self.name} is required")
            return None
        if self.kind == "boolean":
            return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes", "y")
        read = {"integer": int, "float": float, "date": lambda v: v if isinstance(v, date) else date.fromisoformat(str(v)), "datetime": lambda v: v if isinstance(v, datetime) else datetime.fromisoformat(str(v))}
        return read.get(self.kind, str)(value)


@dataclass(frozen=True)
class Report:
    name: str
    description: str
    requires: dict[str, list[str]]  # table: columns
    build: Callable[[Tables, dict[str, Any]], DataFrame]
    parameters: list[Parameter] = field(default_factory=list)
    category: str = "general"

    def missing(self, tables: Tables) -> list[str]:
        """The tables, and the columns of tables that are there, that the report lacks."""
        out = [t for t in self.requires if t not in tables]
        return out + [f"{t}.{c}" for t, columns in self.requires.items() if t in tables for c in columns if c not in tables[t].columns]

    def bind(self, values: dict[str, Any] | None) -> dict[str, Any]:
        """All parameters' values; names that the report does not know are ignored."""
        return {p.name: p.read((values or {}).get(p.name)) for p in self.parameters}


@dataclass
class Result:
    """What a run gave: rows, or why there are none.  A run never raises."""

    report: str
    data: DataFrame | None = None
    error: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict)
    row_count: int = 0
    execution_ms: float = 0.0

    @property
    def success(self) -> bool:
        return self.error is None

    def to_csv(self, path: str) -> None:
        """Files of a folder, with headers; read by name they keep the report's order."""
        if self.data is None:
            raise ValueError(f"report {self.report} has no data")
        self.data.write.mode("overwrite").csv(path, header=True)


def _between(day: Column, p: dict[str, Any]) -> Column:
    out = F.lit(True)
    if p.get("start_date") is not None:
        out = out & (day >= F.lit(p["start_date"]))
    if p.get("end_date") is not None:
        out = out & (day <= F.lit(p["end_date"]))
    return out


def _same(column: Column, value: Any) -> Column:
    return F.lit(True) if value is None else column == F.lit(value)


def _day(c: str) -> Column:
    return F.col(c).cast("string").try_cast("date") if c == "shift_date" else F.col(c).cast("string").try_cast("timestamp").cast("date")


def _kind() -> Column:
    return F.coalesce("detected_shift_type", "shift_type", F.lit("UNKNOWN"))


def _kind_order(c: str = "detected_shift_type") -> Column:
    out = F.lit(len(SHIFT_TYPES) + 1)
    for i, name in enumerate(SHIFT_TYPES):
        out = F.when(F.col(c) == name, i + 1).otherwise(out)
    return out


def _hours() -> Column:
    return F.coalesce(F.col("duration_minutes").cast("double") / 60.0, F.lit(SHIFT_HOURS))


def _rate() -> Column:
    return F.coalesce(F.col("effective_hourly_cost").cast("double"), F.col("hourly_rate").cast("double"), F.lit(0.0))


def _said(*parts: Any) -> Column:
    """Text of columns and strings; empty for what is null."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _money(c: Column | str) -> Column:
    return text_number(F.col(c) if isinstance(c, str) else c, 2)


def _shifts(t: Tables, p: dict[str, Any]) -> DataFrame:
    rows = t[S].where(_between(_day("shift_date"), p) & _same(F.col("department_code"), p.get("department")) & _same(F.col("detected_shift_type"), p.get("shift_type")))
    return rows.withColumn("detected_shift_type", _kind())


def _paid(t: Tables, shifts: DataFrame, *columns: str) -> DataFrame:
    pay = t[C].select("employee_id", *[F.col(c).alias(f"c_{c}") if c in shifts.columns else F.col(c) for c in columns])
    return shifts.join(pay, "employee_id", "left")


def cost_rows(t: Tables, p: dict[str, Any]) -> DataFrame:
    """The rows of ``cost_per_shift`` in no order."""
    rows = _paid(t, _shifts(t, p).drop("employee_name"), "employee_name", "employment_type", "hourly_rate", "effective_hourly_cost", "gross_salary")
    rows = rows.withColumns({"shift_hours": _hours(), "rate": _rate()}).withColumn("shift_cost", rounded(F.col("shift_hours") * F.col("rate"), 2))
    basis = F.when(F.col("employment_type") == "salaried", _said(" (effective rate with 25% benefits loading on gross salary of $", F.coalesce(_money("gross_salary"), F.lit("N/A")), ")")).when(F.col("employment_type") == "contractor", " (contractor rate, no benefits loading)").otherwise("")
    evidence = _said("[", F.col("detected_shift_type"), " SHIFT] Cost calculated as: ", text_number(rounded("shift_hours", 1), 1), " hours × $", _money("rate"), "/hour", basis, " = $", _money("shift_cost"), ". Shift: ", F.col("shift_start"), "-", F.col("shift_end"), " on ", F.col("shift_date"), ".")
    return rows.select("shift_date", "employee_id", "employee_name", "shift_start", "shift_end", "department_code", "detected_shift_type", "employment_type", "hourly_rate", "effective_hourly_cost", "shift_hours", "shift_cost", evidence.alias("evidence"))


def cost_per_shift(t: Tables, p: dict[str, Any]) -> DataFrame:
    return cost_rows(t, p).orderBy(_kind_order(), F.asc_nulls_last("shift_date"), F.asc_nulls_last("shift_start"))


def shift_summary(t: Tables, p: dict[str, Any]) -> DataFrame:
    rows = _paid(t, _shifts(t, p), "employment_type", "hourly_rate", "effective_hourly_cost").withColumns({"hours": _hours(), "cost": _hours() * _rate()})
    of = lambda kind: F.col("employment_type") == kind
    out = rows.groupBy("department_code", "detected_shift_type").agg(
        F.count("*").alias("total_shifts"), F.countDistinct("employee_id").alias("unique_employees"), rounded(F.sum("hours"), 1).alias("total_hours"), rounded(F.avg("hours"), 2).alias("avg_shift_hours"),
        rounded(F.sum("cost"), 2).alias("total_cost"), rounded(F.avg("cost"), 2).alias("avg_shift_cost"), F.count_if(of("salaried")).alias("salaried_shifts"), F.count_if(of("contractor")).alias("contractor_shifts"),
        F.min("shift_date").alias("first_shift"), F.max("shift_date").alias("last_shift"),
        F.coalesce(rounded(F.avg(F.when(of("salaried"), F.col("cost"))), 2), F.lit(0.0)).alias("salaried_avg"), F.coalesce(rounded(F.avg(F.when(of("contractor"), F.col("cost"))), 2), F.lit(0.0)).alias("contractor_avg"),
    )
    evidence = _said("Summary for ", F.col("department_code"), " / ", F.col("detected_shift_type"), " shifts: ", F.col("total_shifts"), " shifts by ", F.col("unique_employees"), " employees from ", F.col("first_shift"), " to ", F.col("last_shift"), ". Total hours: ", text_number(F.col("total_hours"), 1), "h. Staff mix: ", F.col("salaried_shifts"), " salaried ($", _money("salaried_avg"), " avg) + ", F.col("contractor_shifts"), " contractor ($", _money("contractor_avg"), " avg). Total labor cost: $", _money("total_cost"), ".")
    return out.withColumn("evidence", evidence).drop("salaried_avg", "contractor_avg").orderBy(F.asc_nulls_last("department_code"), _kind_order())


def _late(actual: str, planned: str) -> Column:
    return minutes_of_day(F.col(actual).cast("string")) - minutes_of_day(F.col(planned).cast("string"))


def shift_patterns(t: Tables, p: dict[str, Any]) -> DataFrame:
    rows = t[S].where(F.col("detected_shift_type").isNotNull() & (F.col("detected_shift_type") != "UNKNOWN") & _between(_day("shift_date"), p) & _same(F.col("department_code"), p.get("department")))
    rows = rows.withColumn("late", _late("actual_start", "shift_start"))
    out = rows.groupBy(F.col("detected_shift_type").alias("shift_type"), F.col("shift_cluster_id").alias("cluster_id")).agg(
        F.count("*").alias("total_shifts"), F.countDistinct("employee_id").alias("unique_employees"), F.countDistinct("shift_date").alias("days_with_shifts"), F.min("shift_start").alias("earliest_start"), F.max("shift_start").alias("latest_start"),
        F.lit(SHIFT_HOURS).alias("avg_duration_hours"), F.count_if(F.col("late") > 0).alias("late_arrivals"), F.count_if(F.col("late") <= 0).alias("on_time_arrivals"),
        rounded(ratio(F.count_if(F.col("late") > 0) * 100.0, F.count("late")), 1).alias("lateness_rate_pct"), rounded(F.avg(F.when(F.col("late") > 0, F.col("late"))), 0).alias("avg_minutes_late"), rounded(F.avg("shift_detection_confidence") * 100, 0).alias("avg_detection_confidence_pct"),
    )
    delay = F.when(F.col("late_arrivals") > 0, _said(" (avg ", text_number(F.col("avg_minutes_late"), 1), " min late)")).otherwise("")
    evidence = _said("Shift pattern ", F.col("shift_type"), " (cluster ", F.col("cluster_id"), "): ", F.col("total_shifts"), " shifts by ", F.col("unique_employees"), " employees over ", F.col("days_with_shifts"), " days. Starts range from ", F.col("earliest_start"), " to ", F.col("latest_start"), ". Punctuality: ", F.col("on_time_arrivals"), " on-time, ", F.col("late_arrivals"), " late", delay, ". Detection confidence: ", text_number(F.col("avg_detection_confidence_pct"), 1), "%.")
    return out.withColumn("evidence", evidence).orderBy(_kind_order("shift_type"), "cluster_id")


def arrival_status(late: Column, early_limit: int, late_limit: int) -> Column:
    """A null difference is on time, as no rule speaks against it."""
    return F.when(late > late_limit, "LATE").when(late < -early_limit, "TOO_EARLY").when(late < 0, "EARLY_OK").otherwise("ON_TIME")


def departure_status(left: Column) -> Column:
    return F.when(left < LEFT_EARLY, "LEFT_EARLY").when(left > OVERTIME, "OVERTIME").otherwise("NORMAL")


#: Order of flags in the report of lateness.
SEVERITY = {"FLAGGED_LATE": 0, "FLAGGED_TOO_EARLY": 1, "FLAGGED_EARLY_DEPARTURE": 2, "OK": 3}


def compliance_flag(late: Column, left: Column, early_limit: int, late_limit: int) -> Column:
    return F.when(late > late_limit, "FLAGGED_LATE").when(late < -early_limit, "FLAGGED_TOO_EARLY").when(left < LEFT_EARLY, "FLAGGED_EARLY_DEPARTURE").otherwise("OK")


def lateness_rows(t: Tables, p: dict[str, Any]) -> DataFrame:
    """The rows of ``lateness_flags`` in no order."""
    early, late_ = p["early_threshold_minutes"], p["late_threshold_minutes"]
    rows = _shifts(t, p).where(F.col("actual_start").isNotNull() & (F.col("actual_start") != ""))
    late, left = F.col("arrival_diff_minutes"), F.col("departure_diff_minutes")
    rows = rows.withColumns({"arrival_diff_minutes": _late("actual_start", "shift_start"), "departure_diff_minutes": _late("actual_end", "shift_end")})
    how = lambda d, before, after: F.when(d < 0, _said(F.abs(d), before)).when(d == 0, "on time").otherwise(_said(d, after))
    evidence = (
        F.when(late > late_, _said("Arrived at ", F.col("actual_start"), " but shift was scheduled to start at ", F.col("shift_start"), ". Difference: ", late, " minutes late (threshold: ", F.lit(late_), " min)"))
        .when(late < -early, _said("Arrived at ", F.col("actual_start"), " which is ", F.abs(late), " minutes before shift start at ", F.col("shift_start"), " (max allowed early: ", F.lit(early), " min)"))
        .when(left < LEFT_EARLY, _said("Left at ", F.col("actual_end"), " but shift was scheduled to end at ", F.col("shift_end"), ". Left ", F.abs(left), " minutes early (threshold: 15 min)"))
        .when(left > OVERTIME, _said("Left at ", F.col("actual_end"), " which is ", left, " minutes after scheduled end at ", F.col("shift_end"), " (overtime)"))
        .when(late.isNotNull() & left.isNotNull(), _said("Arrived at ", F.col("actual_start"), " for ", F.col("shift_start"), " shift (", how(late, " min early", " min late but within threshold"), "). Departed at ", F.col("actual_end"), " for ", F.col("shift_end"), " end (", how(left, " min early but OK", " min overtime but OK"), ")."))
    )
    return rows.select(
        "employee_id", "employee_name", "shift_date", "department_code", "detected_shift_type", F.col("shift_start").alias("scheduled_start"), "actual_start", F.col("shift_end").alias("scheduled_end"), "actual_end", late, left,
        arrival_status(late, early, late_).alias("arrival_status"), departure_status(left).alias("departure_status"), compliance_flag(late, left, early, late_).alias("compliance_flag"),
        F.when(late > late_, late).otherwise(0).alias("minutes_late"), F.when(late < -early, F.abs(late)).otherwise(0).alias("minutes_too_early"), F.concat(F.lit("["), F.col("detected_shift_type"), F.lit(" SHIFT] "), evidence).alias("evidence"),
    )


def lateness_flags(t: Tables, p: dict[str, Any]) -> DataFrame:
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("compliance_flag"))
    return lateness_rows(t, p).orderBy(_kind_order(), severity, F.desc_nulls_last("arrival_diff_minutes"), F.asc_nulls_last("shift_date"), F.asc_nulls_last("employee_id"))


def moment() -> Column:
    """When a procedure was done; null if that cannot be read."""
    return F.col("performed_datetime").cast("string").try_cast("timestamp")


def activity_measures() -> list[Column]:
    """What was recorded, of a group of procedures."""
    codes = F.array_join(F.array_sort(F.collect_set(F.col("billing_code").cast("string"))), ", ")
    return [F.min(moment()).alias("first_activity"), F.max(moment()).alias("last_activity"), F.count("*").alias("procedure_count"), codes.alias("codes")]


def attendance_rows(rows: DataFrame) -> DataFrame:
    """Shifts with their day's measures, which are null if nothing was recorded, as rows of the report in no order."""
    rows = rows.withColumn("procedure_count", F.coalesce("procedure_count", F.lit(0)))
    idle = F.col("procedure_count") == 0
    where = _said("Employee ", F.col("employee_id"))
    span = _said(F.col("shift_start"), "-", F.col("shift_end"))
    evidence = F.when(idle, _said(where, " (", F.coalesce("employee_name", F.lit("Unknown")), ") was scheduled for ", F.col("detected_shift_type"), " shift ", span, " on ", F.col("shift_date"), " in ", F.col("department_code"), ", but NO clinical procedures were recorded. This may indicate: (1) documentation gap, (2) non-clinical role, or (3) absence not recorded.")).otherwise(_said(where, " worked ", F.col("detected_shift_type"), " shift ", span, " and performed ", F.col("procedure_count"), " procedure(s). First activity at ", F.date_format("first_activity", "HH:mm"), ", last activity at ", F.date_format("last_activity", "HH:mm"), ". Procedures: ", F.coalesce("codes", F.lit("N/A")), "."))
    return rows.select("employee_id", "employee_name", "shift_date", "department_code", "detected_shift_type", "shift_start", "shift_end", "first_activity", "last_activity", "procedure_count", F.when(idle, "NO_ACTIVITY_RECORDED").otherwise("HAS_ACTIVITY").alias("activity_status"), _said("[", F.col("detected_shift_type"), " SHIFT] ", evidence).alias("evidence"))


def attendance_discrepancies(t: Tables, p: dict[str, Any]) -> DataFrame:
    done = t[P].where(_between(_day("performed_datetime"), p)).groupBy(F.col("staff_id").alias("employee_id"), moment().cast("date").alias("day")).agg(*activity_measures())
    rows = _shifts(t, p).withColumn("day", _day("shift_date")).join(done, ["employee_id", "day"], "left")
    return attendance_rows(rows).orderBy(_kind_order(), F.when(F.col("activity_status") == "NO_ACTIVITY_RECORDED", 0).otherwise(1), F.asc_nulls_last("shift_date"), F.asc_nulls_last("employee_id"))


def _procedures(t: Tables, p: dict[str, Any], place: str) -> DataFrame:
    return t[P].where(_between(_day("performed_datetime"), p) & _same(F.col("location"), p.get(place)))


def avg_cost_per_procedure(t: Tables, p: dict[str, Any]) -> DataFrame:
    pay = t[C].select(F.col("employee_id").alias("staff_id"), _rate().alias("rate"))
    rows = _procedures(t, p, "location").join(pay, "staff_id", "left").where("rate > 0").withColumns({"cost": F.col("rate") * PROCEDURE_HOURS, "revenue": F.coalesce(F.col("price").cast("double"), F.lit(0.0))})
    two = lambda c: rounded(c, 2)
    out = rows.groupBy("billing_code").agg(
        F.max("procedure_description").alias("procedure_description"), F.count("*").alias("procedure_count"), F.countDistinct("staff_id").alias("unique_performers"), two(F.avg("cost")).alias("avg_staff_cost"), two(F.min("cost")).alias("min_cost"), two(F.max("cost")).alias("max_cost"),
        two(F.sum("cost")).alias("total_staff_cost"), two(F.avg("revenue")).alias("avg_revenue"), two(F.sum("revenue")).alias("total_revenue"), two(F.avg("revenue") - F.avg("cost")).alias("margin"), rounded(ratio(F.avg("revenue") - F.avg("cost"), F.avg("revenue")) * 100, 1).alias("margin_pct"),
    )
    share = F.when(F.col("margin_pct").isNotNull(), _said(" (", text_number(F.col("margin_pct"), 1), "%)")).otherwise("")
    evidence = _said("Procedure ", F.col("billing_code"), " (", F.col("procedure_description"), "): Performed ", F.col("procedure_count"), " times by ", F.col("unique_performers"), " staff member(s). Staff cost calculation: 0.5 hours (estimated) × hourly rate. Avg staff cost: $", _money("avg_staff_cost"), " (range: $", _money("min_cost"), " - $", _money("max_cost"), "). Avg revenue per procedure: $", _money("avg_revenue"), ". Gross margin: $", _money("margin"), share, ".")
    return out.withColumn("evidence", evidence).drop("margin", "margin_pct").orderBy(F.desc("procedure_count"), F.asc_nulls_last("billing_code"))


def earned_measures() -> list[Column]:
    """What a group of procedures brought in."""
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    detail = F.array_join(F.array_sort(F.collect_list(_said(F.col("billing_code"), " ($", text_number(price, 2), ")"))), "; ")
    return [F.count("*").alias("procedures_performed"), F.sum(price).alias("procedure_revenue"), detail.alias("details")]


def _with_pay(t: Tables, shifts: DataFrame) -> DataFrame:
    """Shifts with their rate of pay."""
    return _paid(t, shifts, "employee_name", "employment_type", "position", "hourly_rate", "effective_hourly_cost").withColumn("rate", _rate())


def paid_shifts(t: Tables, p: dict[str, Any]) -> DataFrame:
    """Shifts with their day, hours and rate of pay."""
    return _with_pay(t, _shifts(t, p).drop("employee_name", "position")).withColumns({"day": _day("shift_date"), "shift_hours": _hours()})


def profit_rows(rows: DataFrame, *more: str) -> DataFrame:
    """Paid shifts with what was earned, null if nothing was, as rows of the report in no order; ``more`` columns follow."""
    rows = rows.withColumns({"shift_cost": rounded(F.col("shift_hours") * F.col("rate"), 2), "procedures_performed": F.coalesce("procedures_performed", F.lit(0)), "procedure_revenue": F.coalesce("procedure_revenue", F.lit(0.0))})
    profit = F.col("procedure_revenue") - F.col("shift_cost")
    rows = rows.withColumns({"gross_profit": rounded(profit, 2), "profit_margin_pct": F.when(F.col("procedure_revenue") > 0, rounded(profit / F.nullif("procedure_revenue", F.lit(0.0)) * 100, 1)).otherwise(0.0)})
    who = _said("[", F.col("detected_shift_type"), " SHIFT] ", F.col("employee_id"), " (", F.coalesce("employee_name", F.lit("Unknown")), ", ", F.coalesce("position", F.lit("N/A")), ") worked ", text_number(F.col("shift_hours"), 2), "h shift on ", F.col("shift_date"), ". Shift cost: $", _money("shift_cost"))
    # The details are the long part: they are put together with the rest in one step.
    evidence = F.when(F.col("procedures_performed") == 0, _said(who, " (", text_number(F.col("shift_hours"), 2), "h × $", _money("rate"), "/h). No procedures recorded - support/admin role or documentation gap. Net cost: -$", _money("shift_cost"), ".")).otherwise(_said(who, ". Performed ", F.col("procedures_performed"), " procedure(s) generating $", _money("procedure_revenue"), " revenue. Procedures: ", F.coalesce("details", F.lit("N/A")), ". Gross profit: $", _money("gross_profit"), " (", text_number(F.col("profit_margin_pct"), 1), "% margin)."))
    return rows.select("shift_date", "department_code", "detected_shift_type", "employee_id", "employee_name", "employment_type", "position", "shift_hours", "shift_cost", "procedures_performed", "procedure_revenue", "gross_profit", "profit_margin_pct", evidence.alias("evidence"), *more)


def _earned(t: Tables, p: dict[str, Any]) -> DataFrame:
    """What procedures of an employee and day brought in at each place; dealt as the join with shifts needs them."""
    places = _procedures(t, p, "department").groupBy(F.col("staff_id").alias("employee_id"), _day("performed_datetime").alias("day"), "location").agg(*earned_measures())
    return places.groupBy("employee_id", "day").agg(F.collect_list(F.struct("procedures_performed", "procedure_revenue", "details")).alias("places"))


def gross_profit_per_shift(t: Tables, p: dict[str, Any]) -> DataFrame:
    # A day's details are long, and every shift of the day has them. So until the rows are sorted, shifts that are alike in the
    # report's order are one row with the day's places, and those of the same hours are one with their number.
    alike = ["detected_shift_type", "shift_date", "department_code", "employee_id"]
    hours = _shifts(t, p).select(*alike, _day("shift_date").alias("day"), _hours().cast("string").alias("hours")).repartition("employee_id", "day").groupBy(*alike, "day", "hours").agg(F.count("*").alias("n"))
    shifts = hours.groupBy(*alike, "day").agg(F.collect_list(F.struct(F.col("hours").cast("double").alias("shift_hours"), "n")).alias("shifts"))
    # Pay comes before the details, which a large table of pay would have shuffled again.
    rows = _with_pay(t, shifts).drop("hourly_rate", "effective_hourly_cost").join(_earned(t, p), ["employee_id", "day"], "left").drop("day")
    rows = rows.orderBy(_kind_order(), F.asc_nulls_last("shift_date"), F.asc_nulls_last("department_code"), F.asc_nulls_last("employee_id"))
    rows = rows.select(*[c for c in rows.columns if c != "places"], F.inline_outer("places"))
    rows = profit_rows(rows.select(*[c for c in rows.columns if c != "shifts"], F.inline("shifts")), "n")
    # Shifts of the same hours share one text, which is made once.
    return rows.select(*[c for c in rows.columns if c not in ("evidence", "n")], F.explode(F.array_repeat("evidence", F.col("n").cast("int"))).alias("evidence"))


# What a flag is said to mean.
MEANING = {"VERY_SLOW": "⚠️ VERY SLOW - Consider training or workload review.", "SLOW": "⚠️ SLOW - May need efficiency improvement.", "FAST": "✓ FAST - High efficiency, potential best practice.", "AVERAGE": "✓ AVERAGE - Within normal range."}


def performance_flag(own: Column, peers: Column) -> Column:
    """Compares averages that are rounded already."""
    return F.when(own > peers * 1.5, "VERY_SLOW").when(own > peers * 1.2, "SLOW").when(own < peers * 0.9, "FAST").otherwise("AVERAGE")


def doctor_performance_by_procedure(t: Tables, p: dict[str, Any]) -> DataFrame:
    # A procedure is in a shift of its day if its minute is; a shift over midnight has none.
    at = moment()
    done = t[P].select(F.col("staff_id").alias("employee_id"), at.cast("date").alias("day"), (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).alias("at"))
    shifts = t[S].where(_between(_day("shift_date"), p) & _same(F.col("department_code"), p.get("department"))).withColumn("day", _day("shift_date"))
    # By hours of the day: an employee with most procedures of a day is as many groups as it has hours.
    work = count_inside(shifts, done, ["employee_id", "day"], time_of_day(F.col("shift_start")), time_of_day(F.col("shift_end")), F.col("at"), 3600, ["employee_id", "day", "department_code", "duration_minutes"])
    # A day's shifts, and its procedures of a code, are summed up before they meet: each procedure meets every shift of its day.
    work = work.where("n > 0").groupBy("employee_id", "day").agg(F.count("*").alias("shifts"), F.sum(_hours() / F.col("n")).alias("hours"))
    pay = t[C].where("position is not null").groupBy("employee_id").agg(F.max("employee_name").alias("employee_name"), F.max("position").alias("position"), F.max("employment_type").alias("employment_type"), F.count("*").alias("pays"), F.sum(_rate()).alias("rates"))
    # Descriptions are keys, as a maximum of texts would have every row sorted.
    code = ["employee_id", "billing_code", "procedure_description"]
    coded = _procedures(t, p, "department").select(F.col("staff_id").alias("employee_id"), _day("performed_datetime").alias("day"), "billing_code", "procedure_description").groupBy("day", *code).agg(F.count("*").alias("done"))
    rows = coded.join(work, ["employee_id", "day"]).groupBy(*code).agg(F.sum(F.col("done") * F.col("shifts")).alias("times"), F.sum(F.col("done") * F.col("hours")).alias("hours"))
    rows = rows.groupBy("employee_id", "billing_code").agg(F.max("procedure_description").alias("procedure_description"), F.sum("times").alias("times"), F.sum("hours").alias("hours")).join(pay, "employee_id")
    n, hours, rates = F.col("times") * F.col("pays"), F.col("hours"), F.col("rates")
    own = rows.where(n >= p["min_procedure_count"]).select(
        "employee_id", "billing_code", "employee_name", "position", "employment_type", "procedure_description", n.alias("procedures_performed"), rounded(hours / F.col("times"), 2).alias("avg_duration_hours"),
        rounded(rates / F.col("pays"), 2).alias("avg_hourly_cost"), rounded(hours * rates / n, 2).alias("avg_cost_per_procedure"), rounded(hours * rates, 2).alias("total_cost"),
    )
    peers = rows.groupBy("billing_code").agg(rounded(F.sum(hours * F.col("pays")) / F.sum(n), 2).alias("dept_avg_duration_hours"), F.count("*").alias("doctors_performing"))
    a, b = F.col("avg_duration_hours"), F.col("dept_avg_duration_hours")
    out = own.join(peers, "billing_code").withColumns({"duration_variance_pct": rounded(ratio(a - b, b) * 100, 1), "performance_flag": performance_flag(a, b)})
    pace = F.when(a > b, _said("Performance: ", text_number(F.col("duration_variance_pct"), 1), "% SLOWER than average. ")).when(a < b, _said("Performance: ", text_number(F.abs("duration_variance_pct"), 1), "% FASTER than average. ")).otherwise("Performance: ON PAR with department average. ")
    says = F.element_at(F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv]), F.col("performance_flag"))
    evidence = _said(F.col("employee_name"), " (", F.col("employee_id"), ", ", F.col("position"), ") performed ", F.col("procedures_performed"), " × ", F.col("billing_code"), " (", F.col("procedure_description"), "). Avg time: ", text_number(a, 2), "h per procedure. Department avg: ", text_number(b, 2), "h (", F.col("doctors_performing"), " doctor(s)). ", pace, "Avg cost: $", _money("avg_cost_per_procedure"), "/procedure. Total cost for this procedure type: $", _money("total_cost"), ". ", says)
    order = {"VERY_SLOW": 0, "SLOW": 1, "FAST": 2, "AVERAGE": 3}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("performance_flag"))
    out = out.select("employee_id", "employee_name", "position", "employment_type", "billing_code", "procedure_description", "procedures_performed", a, b, "doctors_performing", "duration_variance_pct", "performance_flag", "avg_hourly_cost", "avg_cost_per_procedure", "total_cost", evidence.alias("evidence"))
    return out.orderBy(rank, F.asc_nulls_last("billing_code"), F.desc("procedures_performed"), "employee_id")


_DAYS = [Parameter("start_date", "date"), Parameter("end_date", "date")]
_PLACE, _SHIFT = Parameter("department"), Parameter("shift_type")
_LIMITS = [Parameter("early_threshold_minutes", "integer", 30), Parameter("late_threshold_minutes", "integer", 0)]
_S = ["employee_id", "shift_date", "shift_start", "shift_end", "department_code", "shift_type", "detected_shift_type"]
_C = ["employee_id", "employee_name", "employment_type", "hourly_rate", "effective_hourly_cost"]
_P = ["procedure_id", "staff_id", "billing_code", "procedure_description", "performed_datetime", "location", "price"]
REPORTS = [
    Report("attendance_discrepancies", "Shifts against recorded activity", {S: [*_S, "employee_name"], P: _P}, attendance_discrepancies, [*_DAYS, _SHIFT], "compliance"),
    Report("avg_cost_per_procedure", "Staff cost and revenue of each procedure", {P: _P, C: _C}, avg_cost_per_procedure, [*_DAYS, Parameter("location")], "costs"),
    Report("cost_per_shift", "Cost of each shift", {S: [*_S, "duration_minutes"], C: [*_C, "gross_salary"]}, cost_per_shift, [*_DAYS, _PLACE, _SHIFT], "costs"),
    Report("doctor_performance_by_procedure", "Time for a procedure against peers", {S: [*_S, "duration_minutes"], P: _P, C: [*_C, "position"]}, doctor_performance_by_procedure, [*_DAYS, _PLACE, Parameter("min_procedure_count", "integer", 2)], "performance"),
    Report("gross_profit_per_shift", "Revenue less cost of each shift", {S: [*_S, "duration_minutes"], C: [*_C, "position"], P: _P}, gross_profit_per_shift, [*_DAYS, _PLACE, _SHIFT], "profitability"),
    Report("lateness_flags", "Arrivals and departures against the plan", {S: [*_S, "employee_name", "actual_start", "actual_end"]}, lateness_flags, [*_DAYS, *_LIMITS, _PLACE, _SHIFT], "compliance"),
    Report("shift_patterns", "Timing, staffing and punctuality of each pattern", {S: [*_S, "actual_start", "shift_cluster_id", "shift_detection_confidence"]}, shift_patterns, [*_DAYS, _PLACE], "analysis"),
    Report("shift_summary", "Totals by department and shift type", {S: [*_S, "duration_minutes"], C: _C}, shift_summary, [*_DAYS, _SHIFT], "summary"),
]


class Registry:
    """Reports by name; more can be registered."""

    def __init__(self, reports: list[Report] | None = None):
        self._reports = {r.name: r for r in (REPORTS if reports is None else reports)}

    def register(self, report: Report) -> None:
        self._reports[report.name] = report

    def unregister(self, name: str) -> bool:
        return self._reports.pop(name, None) is not None

    def get(self, name: str) -> Report | None:
        return self._reports.get(name)

    def names(self) -> list[str]:
        return sorted(self._reports)

    def applicable(self, tables: Tables) -> list[str]:
        return [n for n in self.names() if not self._reports[n].missing(tables)]

    def run(self, name: str, tables: Tables, parameters: dict[str, Any] | None = None) -> Result:
        """Runs a report; the time is that of counting its rows.  What fails is told in the result."""
        report = self.get(name)
        if report is None:
            return Result(name, error=f"unknown report {name}; known: {', '.join(self.names())}")
        if missing := report.missing(tables):
            return Result(name, error=f"not loaded: {', '.join(missing)}")
        began, bound = perf_counter(), {}
        try:
            bound = report.bind(parameters)
            data = report.build(tables, bound)
            rows = data.count()
        except Exception as e:
            return Result(name, error=f"{type(e).__name__}: {e}", parameters=bound, execution_ms=1000 * (perf_counter() - began))
        return Result(name, data, None, bound, rows, 1000 * (perf_counter() - began))

    def run_all(self, tables: Tables, parameters: dict[str, Any] | None = None) -> dict[str, Result]:
        return {n: self.run(n, tables, parameters) for n in self.applicable(tables)}


def export(results: dict[str, Result], folder: str) -> list[str]:
    """Writes what each successful result has to a CSV folder of the report's name; returns the paths."""
    paths = []
    for name, result in sorted(results.items()):
        if result.success:
            result.to_csv(path := f"{folder}/{name}.csv")
            paths.append(path)
    return paths


def log(results: dict[str, Result]) -> list[dict[str, Any]]:
    """What was run, for a JSON log: report, parameters as text, rows, time and error."""
    return [{"report": r.report, "parameters": {k: None if v is None else str(v) for k, v in r.parameters.items()}, "rows": r.row_count, "execution_ms": round(r.execution_ms, 1), "error": r.error} for r in results.values()]
