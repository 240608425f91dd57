"""JSON texts as typed columns, whose type is that of the data, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parsed(text: Column) -> Column:
    return F.try_parse_json(text.cast("string"))


def schema_of(df: DataFrame, column: str) -> str | None:
    """The type, as DDL, that all well-formed values of a column fit; None if there is no such value.

    It is one aggregate over all rows: what is in some objects only is there, numbers widen, and what
    has unlike types in unlike rows is VARIANT.
    """
    found = df.select(F.schema_of_variant_agg(_parsed(F.col(column))).alias("s")).first()["s"]
    return None if found in (None, "VOID") else found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def decoded(df: DataFrame, column: str, name: str | None = None, schema: str | None = None) -> DataFrame:
    """``df`` with a JSON column as one of its type (``schema``, else that of the data); malformed texts are null.

    Without a well-formed value the column is of strings, all null.
    """
    kind = schema or schema_of(df, column) or "STRING"
    return df.withColumn(name or column, F.try_variant_get(_parsed(F.col(column)), "$", kind))


def malformed(column: str) -> Column:
    """Whether a value is there but no JSON."""
    return F.col(column).isNotNull() & _parsed(F.col(column)).isNull()


def encoded(value: Column) -> Column:
    """A value of any type as JSON, with its nulls, so that decoding gives it back."""
    return F.to_json(value, {"ignoreNullFields": "false"})
