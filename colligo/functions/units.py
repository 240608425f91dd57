"""Unit and format conversions as columns, and what a column's unit is."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor and offset of each conversion, value * factor + offset.
CONVERSIONS = {
    ("hours", "minutes"): (60.0, 0.0),
    ("minutes", "hours"): (1 / 60.0, 0.0),
    ("seconds", "minutes"): (1 / 60.0, 0.0),
    ("minutes", "seconds"): (60.0, 0.0),
    ("hours", "seconds"): (3600.0, 0.0),
    ("seconds", "hours"): (1 / 3600.0, 0.0),
    ("kg", "lbs"): (2.20462, 0.0),
    ("lbs", "kg"): (1 / 2.20462, 0.0),
    ("g", "kg"): (1 / 1000.0, 0.0),
    ("kg", "g"): (1000.0, 0.0),
    ("celsius", "fahrenheit"): (9 / 5.0, 32.0),
    ("fahrenheit", "celsius"): (5 / 9.0, -160 / 9.0),
    ("cm", "inches"): (1 / 2.54, 0.0),
    ("inches", "cm"): (2.54, 0.0),
    ("m", "feet"): (3.28084, 0.0),
    ("feet", "m"): (1 / 3.28084, 0.0),
    ("decimal", "percentage"): (100.0, 0.0),
    ("percentage", "decimal"): (0.01, 0.0),
}
# Other names of units.
ALIASES = {
    "hours": "hrs hr hour h horas שעות heures часов ساعات",
    "minutes": "mins min m minutos דקות minutes минут دقائق",
    "seconds": "secs sec s segundos שניות secondes секунд ثواني",
    "kg": "kilograms kilogram kilo קילו קילוגרם",
    "lbs": "pounds pound lb ליברות",
    "celsius": "c centigrade צלזיוס",
    "fahrenheit": "f פרנהייט",
    "percentage": "% percent pct אחוז",
    "decimal": "dec ratio יחס",
}
# Date formats that become yyyy-MM-dd, and words for yes.
DATE_FORMATS = {"DD/MM/YYYY": "d/M/yyyy", "MM/DD/YYYY": "M/d/yyyy", "DD-MM-YYYY": "d-M-yyyy"}
YES = ["yes", "y", "1", "true", "כן", "sí", "да"]


def convert(value: Column, source: str, target: str) -> Column:
    """``value`` in another unit; a pair without a conversion leaves it as it is."""
    value = value.cast("double")
    if (source, target) not in CONVERSIONS:
        return value
    factor, offset = CONVERSIONS[source, target]
    inverse = CONVERSIONS.get((target, source))
    # Where the way back multiplies by a plain number, dividing by it is exact for more values.
    if inverse and not offset and abs(inverse[0]) > abs(factor):
        return value / F.lit(inverse[0])
    if (source, target) == ("fahrenheit", "celsius"):
        return (value - 32.0) * 5.0 / 9.0
    if (source, target) == ("celsius", "fahrenheit"):
        return value * 9.0 / 5.0 + 32.0
    return value * F.lit(factor)


def iso_date(value: Column, source: str) -> Column:
    """A date string as ``yyyy-MM-dd``; unchanged if it does not fit its format or the format is unknown."""
    pattern = DATE_FORMATS.get(source.upper())
    return value if pattern is None else F.coalesce(F.date_format(F.try_to_timestamp(value, F.lit(pattern)), "yyyy-MM-dd"), value)


def yes(value: Column) -> Column:
    """Whether a value says yes, in one of a few languages; false for null."""
    return F.coalesce(F.lower(value.cast("string")).isin(YES), F.lit(False))


#: Each term's unit: a unit's own name, or another name of it; of units with one term the first counts.
UNIT_OF = {term: unit for unit, others in reversed(ALIASES.items()) for term in (*others.lower().split(), unit)}


def unit_name(name: str | None) -> str | None:
    """A unit's canonical name, or None."""
    return UNIT_OF.get((name or "").strip().lower())


def unit_of_name(column: str, accepted: list[str]) -> str | None:
    """The unit that a column's name ends with, begins with or has as one of its words; of several accepted ones, the one accepted first.

    Names are taken as terms: their words between underscores, and all beginnings and ends of those.
    """
    low = column.lower()
    words = low.split("_")
    heads = [w[:i] for w in words[1:] for i in range(1, len(w) + 1)] + [low[:i] for i in range(1, len(low) + 1)]
    tails = [w[i:] for w in words[:-1] for i in range(len(w))] + [low[i:] for i in range(len(low))]
    shown = {UNIT_OF[t] for t in {*heads, *tails} if t in UNIT_OF}
    return next((u for u in map(unit_name, accepted) if u in shown), None)


def unit_of_values(least: float | None, mean: float | None, most: float | None, target: str, accepted: list[str], fractions: bool = False) -> str | None:
    """What unit a range of values looks like, where it is not likely to be the target's; None if nothing stands out.

    ``fractions``: no value is whole.
    """
    if None in (least, mean, most):
        return None
    # Target, likely unit, and the ranges that say so.
    signs = [
        ("minutes", "hours", least >= 0 and most <= 24 and mean < 15),
        ("minutes", "hours", most < 15 and fractions),
        ("hours", "minutes", least >= 30 and most <= 600),
        ("seconds", "minutes", least >= 0 and most <= 60),
        ("celsius", "fahrenheit", least >= 32 and most <= 212),
        ("fahrenheit", "celsius", least >= -40 and most < 50),
        ("kg", "g", least >= 100 and most >= 1000),
        ("kg", "lbs", 100 <= mean <= 400),
    ]
    return next((unit for to, unit, seen in signs if to == target and seen and unit in accepted), None)


def unit_of_samples(values: list[str] | None, target: str, accepted: list[str]) -> str | None:
    """What unit the numbers among a few sample values look like; texts that are no number are passed over."""
    numbers = []
    for value in values or []:
        try:
            numbers.append(float(value))
        except (TypeError, ValueError):
            continue
    numbers = [x for x in numbers if math.isfinite(x)]
    if not numbers:
        return None
    return unit_of_values(min(numbers), sum(numbers) / len(numbers), max(numbers), target, accepted, all(x % 1 for x in numbers))


def conversion(column: str, target: str | None, accepted: list[str] | None, unit: str | None = None) -> dict:
    """Whether a column needs a conversion to reach its target's unit, and why."""
    if not target or not accepted:
        return {"needed": False, "source": None, "target": None, "confidence": "high", "reason": "the target names no unit"}
    source = unit or unit_of_name(column, accepted)
    if source is None:
        return {"needed": False, "source": None, "target": target, "confidence": "low", "reason": "the source's unit is not known"}
    if source == target:
        return {"needed": False, "source": source, "target": target, "confidence": "high", "reason": "the units are the same"}
    if (source, target) in CONVERSIONS:
        return {"needed": True, "source": source, "target": target, "confidence": "high", "reason": f"{source} become {target}"}
    return {"needed": False, "source": source, "target": target, "confidence": "medium", "reason": f"no conversion from {source} to {target}"}
