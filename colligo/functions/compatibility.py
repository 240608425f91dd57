"""How well a detected type fits a schema field's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detected type, field type, fit.
FITS = [
    ("datetime", "datetime", 1.0), ("date", "date", 1.0), ("time_of_day", "datetime", 0.95), ("integer", "integer", 1.0),
    ("float", "float", 1.0), ("boolean", "boolean", 1.0), ("text", "string", 1.0), ("string", "string", 1.0),
    ("id_like", "string", 1.0), ("categorical", "string", 1.0), ("free_text", "string", 1.0), ("duration", "integer", 0.95),
    ("duration", "float", 0.95), ("datetime", "date", 0.85), ("datetime", "string", 0.85), ("date", "datetime", 0.85),
    ("date", "string", 0.85), ("time_of_day", "string", 0.85), ("time_of_day", "time", 1.0), ("integer", "float", 0.95),
    ("float", "integer", 0.80), ("integer", "string", 0.75), ("float", "string", 0.75), ("duration", "string", 0.70),
    ("boolean", "string", 0.80), ("boolean", "integer", 0.75), ("id_like", "integer", 0.85), ("id_like", "float", 0.70),
    ("text", "text", 1.0), ("categorical", "text", 0.90), ("free_text", "text", 1.0),
]
NUMERIC, MOMENTS = ["integer", "float", "duration"], ["datetime", "date", "time_of_day"]
UNKNOWN, EMPTY, NUMBER, MOMENT, NONE = 0.7, 0.5, 0.85, 0.80, 0.4


def compatibility(detected: Column, field: Column) -> Column:
    """From 0.4, no fit, to 1: by the table in either direction, or by family."""
    source, target = (F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown")) for c in (detected, field))
    table = F.create_map(*[F.lit(x) for a, b, fit in FITS for x in (f"{a}>{b}", fit)])
    at = lambda a, b: F.try_element_at(table, F.concat(a, F.lit(">"), b))
    family = F.when(source.isin(NUMERIC) & target.isin("integer", "float", "number"), NUMBER).when(source.isin(MOMENTS) & target.isin("datetime", "date", "time"), MOMENT)
    return F.when((source == "unknown") | (target == "unknown"), UNKNOWN).when(source == "empty", EMPTY).otherwise(F.coalesce(at(source, target), at(target, source), family, F.lit(NONE)))
