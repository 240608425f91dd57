"""The eight reports themselves, over views of the driver's tables, with SQL that gives the same rows.

Orders stand in for shifts, customers for pay and lines for procedures.  A view's expressions are read
alike by Spark and by DuckDB.  Evidence texts are part of them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import MEANING, C, P, Registry, S


def _text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def _clock(hour: str, minute: str) -> str:
    return f"lpad({_text(f'({hour}) % 24')}, 2, '0') || ':' || lpad({_text(f'({minute}) % 60')}, 2, '0')"


#: Each view's table and columns; hours and rates are quarters, so that sums do not depend on their order.
VIEWS = {
    S: (
        "orders",
        {
            "employee_id": f"'E' || {_text('o_custkey % 100')}",
            "employee_name": f"CASE WHEN o_orderkey % 7 > 0 THEN 'N' || {_text('o_custkey')} END",
            "shift_date": _text("CAST(o_orderdate AS DATE)"),
            "shift_start": _clock("o_orderkey", "0"),
            "shift_end": _clock("o_orderkey + 8", "30"),
            "actual_start": f"CASE WHEN o_orderkey % 11 > 0 THEN {_clock('o_orderkey + 24 - o_custkey % 2', 'o_custkey * 7')} END",
            "actual_end": f"CASE WHEN o_orderkey % 13 > 0 THEN {_clock('o_orderkey + 8', 'o_custkey * 11')} END",
            "duration_minutes": "CASE WHEN o_orderkey % 17 > 0 THEN 240 + (o_custkey % 19) * 15 END",
            "department_code": f"'D' || {_text('o_custkey % 5')}",
            "shift_type": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END",
            "detected_shift_type": "CASE o_orderkey % 7 WHEN 0 THEN 'MORNING' WHEN 1 THEN 'MID_DAY' WHEN 2 THEN 'AFTERNOON' WHEN 3 THEN 'EVENING' WHEN 4 THEN 'NIGHT' WHEN 5 THEN 'UNKNOWN' END",
            "shift_cluster_id": "o_orderkey % 4",
            "shift_detection_confidence": "CAST(o_orderkey % 5 AS DOUBLE) / CAST(4 AS DOUBLE)",
        },
    ),
    C: (
        "customer",
        {
            "employee_id": f"'E' || {_text('c_custkey')}",
            "employee_name": "c_name",
            "employment_type": "CASE c_custkey % 3 WHEN 0 THEN 'salaried' WHEN 1 THEN 'contractor' END",
            "gross_salary": "floor(c_acctbal)",
            "hourly_rate": "CASE WHEN c_custkey % 5 > 0 THEN CAST(20 + c_custkey % 40 AS DOUBLE) / CAST(2 AS DOUBLE) END",
            "effective_hourly_cost": "CASE WHEN c_custkey % 4 > 0 THEN CAST(30 + c_custkey % 40 AS DOUBLE) / CAST(2 AS DOUBLE) END",
            "position": f"CASE WHEN c_custkey % 10 > 0 THEN 'R' || {_text('c_custkey % 3')} END",
        },
    ),
    P: (
        "lineitem",
        {
            "procedure_id": f"{_text('l_orderkey')} || '-' || {_text('l_linenumber')}",
            "staff_id": f"'E' || {_text('l_suppkey % 100')}",
            "billing_code": f"'B' || {_text('l_partkey % 20')}",
            "procedure_description": f"'of B' || {_text('l_partkey % 20')}",
            "performed_datetime": f"{_text('CAST(l_shipdate AS DATE)')} || ' ' || {_clock('l_partkey', '15')} || ':00'",
            "location": f"'D' || {_text('l_orderkey % 5')}",
            "price": "CASE WHEN l_orderkey % 17 > 0 THEN floor(l_extendedprice) END",
        },
    ),
}

_WITH = "WITH " + ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table})" for name, (table, columns) in VIEWS.items())
_KIND = "coalesce(detected_shift_type, shift_type, 'UNKNOWN')"
_HOURS = "coalesce(duration_minutes / 60.0::DOUBLE, 8.0)"
_RATE = "coalesce(effective_hourly_cost, hourly_rate, 0.0::DOUBLE)"


def _gap(actual: str, planned: str) -> str:
    minutes = lambda c: f"(CAST(split_part({c}, ':', 1) AS INTEGER) * 60 + CAST(split_part({c}, ':', 2) AS INTEGER))"
    return f"{minutes(actual)} - {minutes(planned)}"


def _number(value: str, digits: int) -> str:
    """A number in words: no zeros at the end but one."""
    return f"regexp_replace(regexp_replace(printf('%.{digits}f', CAST({value} AS DOUBLE)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0')"


def _apart(gap: str, before: str, after: str) -> str:
    return f"CASE WHEN {gap} < 0 THEN abs({gap}) || '{before}' WHEN {gap} = 0 THEN 'on time' ELSE {gap} || '{after}' END"


_BASIS = f"""CASE employment_type WHEN 'salaried' THEN ' (effective rate with 25% benefits loading on gross salary of $' || coalesce({_number("gross_salary", 2)}, 'N/A') || ')' WHEN 'contractor' THEN ' (contractor rate, no benefits loading)' ELSE '' END"""

#: Each report's parameters and SQL over the views.
CASES: dict[str, tuple[dict[str, Any], str]] = {
    "cost_per_shift": (
        {"department": "D1"},
        f"""SELECT shift_date, s.employee_id, c.employee_name, shift_start, shift_end, department_code, {_KIND} AS detected_shift_type, employment_type, hourly_rate, effective_hourly_cost,
                   {_HOURS} AS shift_hours, round({_HOURS} * {_RATE}, 2) AS shift_cost,
                   '[' || {_KIND} || ' SHIFT] Cost calculated as: ' || {_number(f"round({_HOURS}, 1)", 1)} || ' hours × $' || {_number(_RATE, 2)} || '/hour' || {_BASIS} || ' = $' || {_number(f"round({_HOURS} * {_RATE}, 2)", 2)}
                     || '. Shift: ' || shift_start || '-' || shift_end || ' on ' || shift_date || '.' AS evidence
            FROM {S} s LEFT JOIN {C} c ON s.employee_id = c.employee_id WHERE department_code = 'D1'""",
    ),
    "shift_summary": (
        {"start_date": "1996-01-01"},
        f"""SELECT * EXCLUDE (salaried_avg, contractor_avg), 'Summary for ' || department_code || ' / ' || detected_shift_type || ' shifts: ' || total_shifts || ' shifts by ' || unique_employees || ' employees from ' || first_shift || ' to ' || last_shift
                     || '. Total hours: ' || {_number("total_hours", 1)} || 'h. Staff mix: ' || salaried_shifts || ' salaried ($' || {_number("salaried_avg", 2)} || ' avg) + ' || contractor_shifts || ' contractor ($' || {_number("contractor_avg", 2)}
                     || ' avg). Total labor cost: $' || {_number("total_cost", 2)} || '.' AS evidence
            FROM (SELECT department_code, {_KIND} AS detected_shift_type, count(*) AS total_shifts, count(DISTINCT s.employee_id) AS unique_employees, round(sum({_HOURS}), 1) AS total_hours, round(avg({_HOURS}), 2) AS avg_shift_hours,
                   round(sum({_HOURS} * {_RATE}), 2) AS total_cost, round(avg({_HOURS} * {_RATE}), 2) AS avg_shift_cost, count(*) FILTER (employment_type = 'salaried') AS salaried_shifts,
                   count(*) FILTER (employment_type = 'contractor') AS contractor_shifts, min(shift_date) AS first_shift, max(shift_date) AS last_shift,
                   coalesce(round(avg({_HOURS} * {_RATE}) FILTER (employment_type = 'salaried'), 2), 0) AS salaried_avg, coalesce(round(avg({_HOURS} * {_RATE}) FILTER (employment_type = 'contractor'), 2), 0) AS contractor_avg
            FROM {S} s LEFT JOIN {C} c ON s.employee_id = c.employee_id WHERE shift_date >= '1996-01-01' GROUP BY 1, 2)""",
    ),
    "shift_patterns": (
        {},
        f"""SELECT *, 'Shift pattern ' || shift_type || ' (cluster ' || cluster_id || '): ' || total_shifts || ' shifts by ' || unique_employees || ' employees over ' || days_with_shifts || ' days. Starts range from ' || earliest_start || ' to ' || latest_start
                     || '. Punctuality: ' || on_time_arrivals || ' on-time, ' || late_arrivals || ' late' || CASE WHEN late_arrivals > 0 THEN ' (avg ' || {_number("avg_minutes_late", 1)} || ' min late)' ELSE '' END
                     || '. Detection confidence: ' || {_number("avg_detection_confidence_pct", 1)} || '%.' AS evidence
            FROM (SELECT detected_shift_type AS shift_type, shift_cluster_id AS cluster_id, count(*) AS total_shifts, count(DISTINCT employee_id) AS unique_employees, count(DISTINCT shift_date) AS days_with_shifts, min(shift_start) AS earliest_start,
                   max(shift_start) AS latest_start, 8.0::DOUBLE AS avg_duration_hours, count(*) FILTER (late > 0) AS late_arrivals, count(*) FILTER (late <= 0) AS on_time_arrivals,
                   round(count(*) FILTER (late > 0) * 100.0::DOUBLE / nullif(count(late), 0), 1) AS lateness_rate_pct, round(avg(late) FILTER (late > 0), 0) AS avg_minutes_late, round(avg(shift_detection_confidence) * 100, 0) AS avg_detection_confidence_pct
            FROM (SELECT *, {_gap("actual_start", "shift_start")} AS late FROM {S} WHERE detected_shift_type <> 'UNKNOWN') GROUP BY 1, 2)""",
    ),
    "lateness_flags": (
        {"early_threshold_minutes": 20, "late_threshold_minutes": 5},
        f"""SELECT employee_id, employee_name, shift_date, department_code, {_KIND} AS detected_shift_type, shift_start AS scheduled_start, actual_start, shift_end AS scheduled_end, actual_end, late AS arrival_diff_minutes, gone AS departure_diff_minutes,
                   CASE WHEN late > 5 THEN 'LATE' WHEN late < -20 THEN 'TOO_EARLY' WHEN late < 0 THEN 'EARLY_OK' ELSE 'ON_TIME' END AS arrival_status,
                   CASE WHEN gone < -15 THEN 'LEFT_EARLY' WHEN gone > 30 THEN 'OVERTIME' ELSE 'NORMAL' END AS departure_status,
                   CASE WHEN late > 5 THEN 'FLAGGED_LATE' WHEN late < -20 THEN 'FLAGGED_TOO_EARLY' WHEN gone < -15 THEN 'FLAGGED_EARLY_DEPARTURE' ELSE 'OK' END AS compliance_flag,
                   CASE WHEN late > 5 THEN late ELSE 0 END AS minutes_late, CASE WHEN late < -20 THEN -late ELSE 0 END AS minutes_too_early,
                   '[' || {_KIND} || ' SHIFT] ' || CASE WHEN late > 5 THEN 'Arrived at ' || actual_start || ' but shift was scheduled to start at ' || shift_start || '. Difference: ' || late || ' minutes late (threshold: 5 min)'
                     WHEN late < -20 THEN 'Arrived at ' || actual_start || ' which is ' || -late || ' minutes before shift start at ' || shift_start || ' (max allowed early: 20 min)'
                     WHEN gone < -15 THEN 'Left at ' || actual_end || ' but shift was scheduled to end at ' || shift_end || '. Left ' || -gone || ' minutes early (threshold: 15 min)'
                     WHEN gone > 30 THEN 'Left at ' || actual_end || ' which is ' || gone || ' minutes after scheduled end at ' || shift_end || ' (overtime)'
                     WHEN gone IS NOT NULL THEN 'Arrived at ' || actual_start || ' for ' || shift_start || ' shift (' || {_apart("late", " min early", " min late but within threshold")} || '). Departed at ' || actual_end || ' for ' || shift_end || ' end ('
                       || {_apart("gone", " min early but OK", " min overtime but OK")} || ').' END AS evidence
            FROM (SELECT *, {_gap("actual_start", "shift_start")} AS late, {_gap("actual_end", "shift_end")} AS gone FROM {S} WHERE actual_start <> '')""",
    ),
    "attendance_discrepancies": (
        {},
        f"""SELECT s.employee_id, employee_name, shift_date, department_code, {_KIND} AS detected_shift_type, shift_start, shift_end, first_activity, last_activity, coalesce(n, 0) AS procedure_count,
                   CASE WHEN n IS NULL THEN 'NO_ACTIVITY_RECORDED' ELSE 'HAS_ACTIVITY' END AS activity_status,
                   '[' || {_KIND} || ' SHIFT] Employee ' || s.employee_id || CASE WHEN n IS NULL THEN ' (' || coalesce(employee_name, 'Unknown') || ') was scheduled for ' || {_KIND} || ' shift ' || shift_start || '-' || shift_end || ' on ' || shift_date || ' in ' || department_code
                       || ', but NO clinical procedures were recorded. This may indicate: (1) documentation gap, (2) non-clinical role, or (3) absence not recorded.'
                     ELSE ' worked ' || {_KIND} || ' shift ' || shift_start || '-' || shift_end || ' and performed ' || n || ' procedure(s). First activity at ' || first_activity || ', last activity at ' || last_activity || '. Procedures: ' || codes || '.' END AS evidence
            FROM {S} s LEFT JOIN (SELECT staff_id, substr(performed_datetime, 1, 10) AS day, min(substr(performed_datetime, 12, 5)) AS first_activity, max(substr(performed_datetime, 12, 5)) AS last_activity, string_agg(DISTINCT billing_code, ', ' ORDER BY billing_code) AS codes, count(*) AS n FROM {P} GROUP BY 1, 2) d
              ON d.staff_id = s.employee_id AND d.day = shift_date""",
    ),
    "avg_cost_per_procedure": (
        {},
        f"""SELECT * EXCLUDE (margin, margin_pct), 'Procedure ' || billing_code || ' (' || procedure_description || '): Performed ' || procedure_count || ' times by ' || unique_performers || ' staff member(s). Staff cost calculation: 0.5 hours (estimated) × hourly rate. Avg staff cost: $'
                     || {_number("avg_staff_cost", 2)} || ' (range: $' || {_number("min_cost", 2)} || ' - $' || {_number("max_cost", 2)} || '). Avg revenue per procedure: $' || {_number("avg_revenue", 2)} || '. Gross margin: $' || {_number("margin", 2)}
                     || coalesce(' (' || {_number("margin_pct", 1)} || '%)', '') || '.' AS evidence
            FROM (SELECT billing_code, max(procedure_description) AS procedure_description, count(*) AS procedure_count, count(DISTINCT staff_id) AS unique_performers, round(avg(cost), 2) AS avg_staff_cost, round(min(cost), 2) AS min_cost,
                   round(max(cost), 2) AS max_cost, round(sum(cost), 2) AS total_staff_cost, round(avg(earned), 2) AS avg_revenue, round(sum(earned), 2) AS total_revenue,
                   round(avg(earned) - avg(cost), 2) + 0.0 AS margin, round((avg(earned) - avg(cost)) / nullif(avg(earned), 0) * 100, 1) + 0.0 AS margin_pct
            FROM (SELECT p.*, {_RATE} * 0.5::DOUBLE AS cost, coalesce(price, 0.0::DOUBLE) AS earned FROM {P} p JOIN {C} c ON staff_id = employee_id) WHERE cost > 0 GROUP BY billing_code)""",
    ),
    "gross_profit_per_shift": (
        {},
        f"""SELECT * EXCLUDE (rate, details), '[' || detected_shift_type || ' SHIFT] ' || employee_id || ' (' || coalesce(employee_name, 'Unknown') || ', ' || coalesce(position, 'N/A') || ') worked ' || {_number("shift_hours", 2)} || 'h shift on ' || shift_date || '. Shift cost: $' || {_number("shift_cost", 2)}
                     || CASE WHEN procedures_performed = 0 THEN ' (' || {_number("shift_hours", 2)} || 'h × $' || {_number("rate", 2)} || '/h). No procedures recorded - support/admin role or documentation gap. Net cost: -$' || {_number("shift_cost", 2)} || '.'
                        ELSE '. Performed ' || procedures_performed || ' procedure(s) generating $' || {_number("procedure_revenue", 2)} || ' revenue. Procedures: ' || details || '. Gross profit: $' || {_number("gross_profit", 2)} || ' (' || {_number("profit_margin_pct", 1)} || '% margin).' END AS evidence
            FROM (SELECT rate, details, shift_date, department_code, kind AS detected_shift_type, employee_id, employee_name, employment_type, position, hours AS shift_hours, cost AS shift_cost, n AS procedures_performed, earned AS procedure_revenue,
                   round(earned - cost, 2) + 0.0 AS gross_profit, CASE WHEN earned > 0 THEN round((earned - cost) / earned * 100, 1) + 0.0 ELSE 0.0 END AS profit_margin_pct
            FROM (SELECT s.*, c.employee_name, employment_type, position, {_KIND} AS kind, {_HOURS} AS hours, {_RATE} AS rate, d.details, round({_HOURS} * {_RATE}, 2) AS cost, coalesce(d.n, 0) AS n, coalesce(d.earned, 0.0::DOUBLE) AS earned
                  FROM (SELECT * EXCLUDE (employee_name) FROM {S}) s LEFT JOIN {C} c ON s.employee_id = c.employee_id
                  LEFT JOIN (SELECT staff_id, substr(performed_datetime, 1, 10) AS day, location, count(*) AS n, sum(coalesce(price, 0.0::DOUBLE)) AS earned,
                               string_agg(billing_code || ' ($' || {_number("coalesce(price, 0)", 2)} || ')', '; ' ORDER BY billing_code || ' ($' || {_number("coalesce(price, 0)", 2)} || ')') AS details FROM {P} GROUP BY 1, 2, 3) d ON d.staff_id = s.employee_id AND d.day = shift_date))""",
    ),
    "doctor_performance_by_procedure": (
        {"min_procedure_count": 2},
        f"""SELECT *, employee_name || ' (' || employee_id || ', ' || position || ') performed ' || procedures_performed || ' × ' || billing_code || ' (' || procedure_description || '). Avg time: ' || {_number("avg_duration_hours", 2)} || 'h per procedure. Department avg: '
                     || {_number("dept_avg_duration_hours", 2)} || 'h (' || doctors_performing || ' doctor(s)). Performance: ' || CASE WHEN avg_duration_hours > dept_avg_duration_hours THEN {_number("duration_variance_pct", 1)} || '% SLOWER than average. '
                        WHEN avg_duration_hours < dept_avg_duration_hours THEN {_number("abs(duration_variance_pct)", 1)} || '% FASTER than average. ' ELSE 'ON PAR with department average. ' END
                     || 'Avg cost: $' || {_number("avg_cost_per_procedure", 2)} || '/procedure. Total cost for this procedure type: $' || {_number("total_cost", 2)} || '. '
                     || CASE performance_flag {" ".join(f"WHEN '{flag}' THEN '{says}'" for flag, says in MEANING.items())} END AS evidence
            FROM (SELECT o.*, peer AS dept_avg_duration_hours, doctors_performing, round((avg_duration_hours - peer) / nullif(peer, 0) * 100, 1) + 0.0 AS duration_variance_pct,
                   CASE WHEN avg_duration_hours > peer * 1.5::DOUBLE THEN 'VERY_SLOW' WHEN avg_duration_hours > peer * 1.2::DOUBLE THEN 'SLOW' WHEN avg_duration_hours < peer * 0.9::DOUBLE THEN 'FAST' ELSE 'AVERAGE' END AS performance_flag
            FROM (SELECT employee_id, max(employee_name) AS employee_name, max(position) AS position, max(employment_type) AS employment_type, billing_code, max(procedure_description) AS procedure_description, count(*) AS procedures_performed,
                         round(avg(hours), 2) AS avg_duration_hours, round(avg(rate), 2) AS avg_hourly_cost, round(avg(hours * rate), 2) AS avg_cost_per_procedure, round(sum(hours * rate), 2) AS total_cost FROM timed GROUP BY employee_id, billing_code HAVING count(*) >= 2) o
            JOIN (SELECT billing_code, round(avg(hours), 2) AS peer, count(DISTINCT employee_id) AS doctors_performing FROM timed GROUP BY billing_code) g ON g.billing_code = o.billing_code)""",
    ),
}
#: Hours for each procedure of the last report: those of its shift, shared by what was done in it.
_TIMED = f"""shared AS (SELECT s.employee_id, shift_date, {_HOURS} / count(procedure_id) AS hours
                        FROM {S} s JOIN {P} p ON staff_id = s.employee_id AND substr(performed_datetime, 1, 10) = shift_date AND substr(performed_datetime, 12, 8) BETWEEN shift_start || ':00' AND shift_end || ':00'
                        GROUP BY s.employee_id, shift_date, department_code, duration_minutes),
             timed AS (SELECT c.employee_id, c.employee_name, position, employment_type, {_RATE} AS rate, billing_code, procedure_description, hours
                       FROM {P} p JOIN shared ON staff_id = shared.employee_id AND substr(performed_datetime, 1, 10) = shift_date JOIN {C} c ON c.employee_id = staff_id WHERE position IS NOT NULL)"""


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The reports' tables as views of the driver's."""
    return {name: spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for name, (table, columns) in VIEWS.items()}


def _query(name: str, parameters: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = Registry().get(name)
        rows = report.build(views(spark, sf_dir), report.bind(parameters))
        return rows.withColumns({c: F.date_format(c, "HH:mm") for c in ("first_activity", "last_activity") if c in rows.columns})

    return run


QUERIES = {f"report_{name}": _query(name, parameters) for name, (parameters, _) in CASES.items()}
SQL = {f"report_{name}": f"{_WITH}{', ' + _TIMED if 'timed' in sql else ''} {sql}" for name, (_, sql) in CASES.items()}
