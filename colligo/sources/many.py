"""Many CSV files of unlike headers in one plan: every file's rows as cells, and what is wrong with which file."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_ROWS = "file string, block long, seq long, fields array<string>"
#: Lines of an unclosed quotation that are gathered until it counts as a fault of the line that opens it.
LONGEST_QUOTE = 1000


def _complete(lines: list[str]) -> int:
    """How many of the lines end outside of a quotation; all, if one is open for too long."""
    odd = list(accumulate(line.count('"') for line in lines))
    cut = next((i for i in range(len(lines), 0, -1) if odd[i - 1] % 2 == 0), 0)
    return cut if len(lines) - cut < LONGEST_QUOTE else len(lines)


def _parse(lines: list[str]) -> list[list[str]]:
    """Rows of CSV lines; quotations may span lines, blank lines are no rows."""
    return [r for r in csv.reader([f"{line}\n" for line in lines]) if r]


def _first_rows(most: int | None):
    """The first ``most`` rows, and the header's, of each block of each file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        lines: list[str] = []
        seq, enough = 0, False

        def out(rows: list[list[str]]) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["file", "block", "seq", "fields"])

        def flushed(last: bool) -> Iterator[pa.RecordBatch]:
            """Complete rows of the lines so far; an open quotation waits for the next ones."""
            nonlocal lines, seq, enough
            cut = len(lines) if last else _complete(lines)
            rows, lines = _parse(lines[:cut]), lines[cut:]
            if most is not None:
                rows = rows[: most + 1 - seq]
            if rows:
                yield out(rows)
                seq += len(rows)
            enough = most is not None and seq > most

        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                if (file, block) != now:
                    if now is not None and not enough:
                        yield from flushed(True)
                    now, lines, seq, enough = (file, block), [], 0, False
                if not enough:
                    lines.append(line)
            if now is not None and not enough:
                yield from flushed(False)
        if now is not None and not enough:
            yield from flushed(True)

    return run


def read(spark: SparkSession, paths: str | list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(cells, files)`` of all CSV files under ``paths``, by one scan.

    ``cells``: file, column_position, column_name, row, value, every value as text; empty ones are null.  With
    ``rows``, of each file the first so many rows: each task stops to parse a file's block after them, and only
    those leave it.  ``files``: file, columns, rows, error; a file without a header, or with a name twice in
    it, has an error and no cells.  Fields beyond the header are left out, those that a row lacks are null.
    Names are trimmed, and a byte order mark is no part of the first one.  Empty files have no lines, so they
    are in neither result: a caller who names files finds them missing.  Local files go by their plain paths.
    """
    path = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"\+", "%2B"), "^file:/+", "/"))
    lines = spark.read.text(paths).select(path.alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    parsed = lines.mapInArrow(_first_rows(rows), _ROWS)
    is_header = (F.col("block") == 0) & (F.col("seq") == 0)
    trimmed = F.transform("fields", lambda x: F.trim(F.regexp_replace(x, "^\ufeff", "")))
    header = parsed.where(is_header).select("file", trimmed.alias("names"))
    fault = F.when(F.exists("names", lambda x: x == ""), "a column has no name").when(F.size("names") != F.size(F.array_distinct("names")), "a name is there twice")
    header = header.withColumn("error", fault)
    data = parsed.where(~is_header)
    if rows is not None:  # of a file in several blocks the first rows
        data = data.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("block", "seq"))).where(F.col("n") <= rows).drop("n")
    whole = data.join(header.where("error IS NULL"), "file")
    cell = F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.struct(i.alias("column_position"), F.get("names", i).alias("column_name"), F.nullif(F.get("fields", i), F.lit("")).alias("value")))
    order = F.col("block") + F.col("seq")  # a block has more bytes than rows
    cells = whole.select("file", order.alias("row"), F.inline(cell)).select("file", "column_position", "column_name", "row", "value")
    counted = data.groupBy("file").agg(F.count("*").alias("rows"))
    files = header.join(counted, "file", "left").select("file", F.size("names").alias("columns"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "error")
    return cells, files
