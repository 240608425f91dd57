"""Which date format a whole column has: the ones that all of its values allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of formats, their shape (day, month and year as groups d, m and y), and how Spark reads them.  Of several that fit the first counts.
FORMATS = {
    "YYYY-MM-DD": ("ymd", "-", "yyyy-M-d"),
    "YYYY/MM/DD": ("ymd", "/", "yyyy/M/d"),
    "DD/MM/YYYY": ("dmy", "/", "d/M/yyyy"),
    "MM/DD/YYYY": ("mdy", "/", "M/d/yyyy"),
    "DD-MM-YYYY": ("dmy", "-", "d-M-yyyy"),
    "MM-DD-YYYY": ("mdy", "-", "M-d-yyyy"),
    "DD.MM.YYYY": ("dmy", ".", "d.M.yyyy"),
    "YYYYMMDD": ("ymd", "", "yyyyMMdd"),
}


#: Three numbers with one mark between them, the year first or last.
_PARTED = r"^(\d{4}([-/])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})$"


def _valid(y: Column, m: Column, d: Column) -> Column:
    """Whether there is such a day; false for nulls."""
    leap = (m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    longest = F.get(F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), m - 1) + leap.cast("int")
    return F.coalesce((y >= 1) & (d >= 1) & (d <= longest), F.lit(False))


def allowed(value: Column) -> Column:
    """A whole number with a bit for each of FORMATS that a value is a date in; null for null and blank values.

    Parts are cut out and held against the calendar as numbers, so no format is tried that fails.
    """
    text = F.trim(value.cast("string"))
    pieces, mark = F.split(F.when(text.rlike(_PARTED), text), "[-/.]"), F.regexp_extract(text, r"^\d+([-/.])", 1)
    first, second, third = (F.get(pieces, F.lit(i)).cast("int") for i in range(3))
    digits = F.when(text.rlike(r"^\d{8}$"), text)
    year_first = F.length(F.get(pieces, F.lit(0))) == 4
    fits = {
        "ymd": year_first & _valid(first, second, third), "dmy": ~year_first & _valid(third, second, first), "mdy": ~year_first & _valid(third, first, second),
        "": _valid(*(F.substring(digits, i, n).cast("int") for i, n in ((1, 4), (5, 2), (7, 2)))),
    }
    out = F.when(fits[""], 1 << list(FORMATS).index("YYYYMMDD")).otherwise(0)
    for order in ("ymd", "dmy", "mdy"):
        bits = F.lit(0)
        for bit, (own, sign, _) in enumerate(FORMATS.values()):
            if own == order and sign:
                bits = F.when(mark == sign, 1 << bit).otherwise(bits)
        out = out + F.when(fits[order], bits).otherwise(0)
    return F.when(text != "", out)


def column_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, date_format, candidates, values, misfits`` for each of ``columns``, by one aggregate of the table.

    ``date_format``: the first format that all values allow, null if there is none or no value; ``candidates``
    has all of them, so that day and month are told apart by the whole column, and are open only if no
    day is above 12.  ``misfits``: values that are a date in no format; one is enough for no format.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, date_format string, candidates array<string>, values long, misfits long")
    # Cells one below the other: the expression is compiled once, and each task sends its different values.
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    # A value is read once, however often it occurs.
    masks = cells.groupBy("column_name", "value").agg(F.count("*").alias("n")).select("column_name", "n", allowed(F.col("value")).alias("mask"))
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = masks.groupBy("column_name").agg(F.bit_and("mask").alias("mask"), number(F.col("mask").isNotNull()).alias("values"), number(F.col("mask") == 0).alias("misfits"))
    fits = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << bit)) > 0, F.lit(name)) for bit, name in enumerate(FORMATS)]), lambda x: x.isNotNull())
    return found.select("column_name", F.get(fits, F.lit(0)).alias("date_format"), F.coalesce(fits, F.array().cast("array<string>")).alias("candidates"), "values", "misfits")


def read(value: Column, date_format: str) -> Column:
    """The date of a value in one of FORMATS; null where it does not fit."""
    bit = list(FORMATS).index(date_format)
    fits = F.coalesce(allowed(value).bitwiseAND(F.lit(1 << bit)) > 0, F.lit(False))
    return F.when(fits, F.to_date(F.trim(value.cast("string")), FORMATS[date_format][2]))
