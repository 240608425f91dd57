"""Columns that read values of unknown origin from strings.  All of them give null where a value does not fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for no value (fixed values).
NULL_LIKE = ["", "na", "n/a", "null", "none", "-", "--", "nan"]
TRUE_LIKE, FALSE_LIKE = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]
#: Shapes that are counted for a column (fixed values).
SHAPES = {
    "time_like": r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$",
    "int_like": r"^\s*[-+]?\d+\s*$",
    "float_like": r"^\s*[-+]?\d+(\.\d+)?\s*$",
    "id_like": r"^[A-Za-z0-9][A-Za-z0-9_\-]{3,}$",
    "pure_number_like": r"^\s*\d+\s*$",
    "duration_suffix_like": r"^\s*[-+]?\d+(\.\d+)?\s*[hmsHMS]\s*$",
}
#: What a value needs for any of the formats below; one without it is not tried, as a failed trial is slow.
_DAY_LIKE, _MOMENT_LIKE = r"\d[-/]\d+[-/]\d", r"\d[-/]\d+[-/]\d+[ T]+\d+:\d"
#: Formats in order of trial; the first that fits gives the value.  One letter takes one digit or two.
DATETIME_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d H:m", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m"]
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy"]


def normalised(value: Column) -> Column:
    """Trimmed, with inner white space as one space; null for what stands for no value."""
    text = F.trim(F.regexp_replace(value.cast("string"), r"\s+", " "))
    return F.when(~F.lower(text).isin(NULL_LIKE), text)


def cleaned_number(value: Column) -> Column:
    """Without thousands separators and currency signs."""
    return F.regexp_replace(F.trim(value), "[,$₪€£]", "")


def number(value: Column) -> Column:
    clean = cleaned_number(value)
    return F.when(clean.rlike(SHAPES["float_like"]), clean.try_cast("double"))


def is_whole(value: Column) -> Column:
    return F.coalesce(value == F.floor(value), F.lit(False))


def datetime(value: Column) -> Column:
    """The first of DATETIME_FORMATS that fits; bare digits are no datetime."""
    return F.when(value.rlike(_MOMENT_LIKE), F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATETIME_FORMATS]))


def date(value: Column) -> Column:
    """The first of DATE_FORMATS that fits; bare digits are no date."""
    return F.when(value.rlike(_DAY_LIKE), F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS]).cast("date"))


def _clock(value: Column) -> list[Column]:
    # Only what has the shape is cast: a cast that fails, even that of an empty string, is slow.
    parts = F.split(F.when(value.rlike(SHAPES["time_like"]), value), ":")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return [part(0), part(1), F.coalesce(part(2), F.lit(0))]


def time_of_day(value: Column) -> Column:
    """Seconds since midnight of ``H:MM[:SS]`` before 24:00."""
    h, m, s = _clock(value)
    return F.when(value.rlike(SHAPES["time_like"]) & (h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)


def minutes_of_day(value: Column) -> Column:
    """Minutes since midnight of ``H:MM[:SS]``."""
    return F.floor(time_of_day(value) / 60).cast("int")


def clock(minutes: Column) -> Column:
    """``HH:MM`` of minutes since midnight, modulo a day."""
    m = F.pmod(minutes.cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60)


def duration_seconds(value: Column) -> Column:
    """Whole seconds of ``H:MM[:SS]`` (any number of hours) or of a number with h, m or s."""
    h, m, s = _clock(value)
    low = F.lower(F.trim(value))
    amount = F.nullif(F.regexp_extract(low, r"^([-+]?\d+(?:\.\d+)?)\s*[hms]$", 1), F.lit("")).try_cast("double")
    unit = F.substring(low, -1, 1)
    factor = F.when(unit == "h", 3600.0).when(unit == "m", 60.0).otherwise(1.0)
    signed = F.when(amount < 0, F.ceil(amount * factor)).otherwise(F.floor(amount * factor)).cast("long")
    clock_ = F.when(value.rlike(SHAPES["time_like"]) & (m <= 59) & (s <= 59), (h * 3600 + m * 60 + s).cast("long"))
    return F.coalesce(clock_, F.when(value.rlike(SHAPES["duration_suffix_like"]), signed))


def boolean(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(TRUE_LIKE), True).when(low.isin(FALSE_LIKE), False)


def text_number(value: Column, digits: int = 2) -> Column:
    """A number as text, the same for every magnitude: no exponent, no zeros at the end but one."""
    fixed = F.format_string(f"%.{digits}f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def rounded(value: Column | str, digits: int = 0) -> Column:
    """``value`` to so many digits, halves away from zero, as scaled doubles round; never a negative zero."""
    value, scale = (F.col(value) if isinstance(value, str) else value).cast("double"), 10.0**digits
    return F.round(value * scale) / scale


def ratio(over: Column, under: Column) -> Column:
    """A quotient of doubles, null for a zero or null denominator."""
    return over.cast("double") / F.nullif(under.cast("double"), F.lit(0.0))


def snake(value: Column) -> Column:
    """A name in lower case with one underscore for what separates its words."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[_\-. \s]+", "_")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
