"""Target schemas: what a table of a type can have, as a small table of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Document type, then its fields as name, type (! if required), unit or format if any, other names.
SCHEMAS = {
    "employee_shifts": """
        shift_id string | shift_no roster_id
        employee_id string! | emp_id staff_id staff_code worker_id employee_no
        shift_date date! =YYYY-MM-DD | work_date work_dt date day
        shift_start datetime! | start_time start clock_in scheduled_start from
        shift_end datetime! | end_time end clock_out scheduled_end to
        duration_minutes integer =minutes | duration dur_hrs hrs hours duration_min
        actual_start datetime | arrived arrival check_in
        actual_end datetime | left departure check_out
        actual_hours float =minutes | worked_hours hours_worked
        department_code string | department dept unit_code ward
        shift_type string | shift type
        employee_name string | name staff_name worker
        is_supervisor boolean | supervisor lead
        break_minutes integer =minutes | break break_min pause""",
    "employee_compensation": """
        employee_id string! | emp_id staff_id worker_id
        employee_name string! | name staff_name
        employment_type string! | contract contract_type emp_type
        gross_salary float | salary monthly_salary gross
        hourly_rate float | rate hourly wage
        monthly_hours integer | hours_per_month contracted_hours
        effective_hourly_cost float | cost_per_hour hourly_cost
        department string | dept unit
        position string | role title job
        start_date date =YYYY-MM-DD | hired hire_date
        currency string | curr""",
    "staff_clinical_procedures": """
        procedure_id string! | proc_id id action_id
        patient_ref string! | patient_id patient mrn
        staff_id string! | doctor_id employee_id performer physician_id
        billing_code string! | code cpt procedure_code
        procedure_description string | description procedure_name
        performed_datetime datetime! | performed_at date_time timestamp
        location string | department room site
        diagnosis_code string | icd diagnosis
        price float | fee amount charge
        clinical_notes string | notes comments""",
    "patient_appointments": """
        appointment_id string! | appt_id booking_id
        patient_id string! | patient mrn
        patient_name string | name
        appointment_date date! =YYYY-MM-DD | appt_date visit_date
        appointment_time datetime! | appt_time time
        end_time datetime | until
        duration_minutes integer =minutes | duration length
        doctor_id string | physician_id provider_id
        doctor_name string | doctor physician provider
        department string | dept clinic
        appointment_type string | appt_type visit_type
        status string | state
        room string | office
        notes string | comments
        phone string | telephone mobile
        created_at datetime | booked_at
        procedure_code string | code
        procedure_name string | procedure
        procedure_category string | category
        price float | fee
        billed_amount float | billed
        balance_due float | balance
        payer string | insurer insurance
        provider_fee float | doctor_fee
        clinic_location string | location site
        total_invoice float | invoice total""",
    "lab_results": """
        result_id string! | lab_id accession
        patient_id string! | patient mrn
        test_code string! | code loinc
        test_name string | test analyte
        result_value string! | value result
        result_unit string | unit units
        reference_range string | range normal_range
        collected_at datetime! | collection_time drawn_at
        resulted_at datetime | result_time reported_at
        status string | flag
        ward string | unit department
        nurse_id string | collected_by""",
}


_FIELDS = "vertical string, document_type string, field_position int, field_name string, field_type string, required boolean, unit string, aliases array<string>"


def fields(spark: SparkSession, vertical: str = "medical", schemas: dict[str, str] | None = None) -> DataFrame:
    """``vertical, document_type, field_position, field_name, field_type, required, unit, aliases``."""
    rows, at = [], 0
    for document_type, text in (schemas or SCHEMAS).items():
        for line in filter(None, map(str.strip, text.splitlines())):
            left, _, others = line.partition("|")
            name, kind, *unit = left.split()
            rows.append((vertical, document_type, at, name, kind.rstrip("!"), kind.endswith("!"), unit[0][1:] if unit else None, others.split()))
            at += 1
    return spark.createDataFrame(rows, _FIELDS)


def from_documents(spark: SparkSession, documents: list[tuple[str, dict]], contexts: dict[str, dict] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The same from files' contents, ``(file, schema)``, with ``text``: what a field is said to be; and why others are left out.

    A schema has ``name``, ``vertical`` and ``fields``; a field ``name``, ``type``, ``required``, ``aliases``,
    ``target_unit`` or ``target_format``, ``embedding_text`` or ``description``.  ``contexts``: for a
    vertical, more names of fields (``terminology``: name to names) and what they mean (``field_contexts``).
    """
    rows, errors, at = [], {}, 0
    for name, data in documents:
        try:
            vertical, own = data.get("vertical", "general"), []
            context = (contexts or {}).get(vertical) or {}
            for f in data["fields"]:
                known = (context.get("terminology") or {}).get(f["name"]) or []
                aliases = [*dict.fromkeys([*(f.get("aliases") or []), *([known] if isinstance(known, str) else known)])]
                meaning = ((context.get("field_contexts") or {}).get(f["name"]) or {}).get("semantic_description")
                text = " ".join(filter(None, [f.get("embedding_text") or f.get("description"), meaning])) or None
                own.append((vertical, data["name"], at + len(own), f["name"], f.get("type", "string"), bool(f.get("required", False)), f.get("target_unit") or f.get("target_format"), [str(a) for a in aliases], text))
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        rows += own
        at += len(own)
    return spark.createDataFrame(rows, f"{_FIELDS}, text string"), errors
