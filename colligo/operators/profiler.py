"""What a table's columns are: one row of statistics and a detected type for each.

The table is unpivoted once, in a pass that keeps, of each column, the counts and the first non-null
values in a given order of every partition.  Only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import parsing as P

SAMPLE, EXAMPLES = 2000, 15
#: Partitions' samples are narrowed again in so many parts.
PARTS = 64
#: Words in a column's name that hint at a duration (fixed values).
DURATION_HINTS = ["duration", "dur", "elapsed", "turnover", "turn over", "tat", "t.a.t", "mins", "min", "minutes", "hours", "hrs", "sec", "seconds"]
#: Types in the order that decides between equal scores.
TYPES = ["datetime", "date", "time_of_day", "duration", "integer", "float", "boolean", "categorical", "free_text", "id_like", "text"]


def _cell(df: DataFrame, name: str) -> Column:
    """A column's values as normalised text; numbers, dates and the like have no white space to see to."""
    column = F.col(f"`{name}`")
    if df.schema[name].dataType.simpleString() in ("string", "binary") or isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
        return P.normalised(column)
    text = column.cast("string")
    return F.when(~F.lower(text).isin(P.NULL_LIKE), text)


def _narrowing(names: list[str], keys: list[str], size: int):
    """Keeps of each column the counts and the first ``size`` non-null values of a partition, in the order of ``keys`` and the values."""
    order = [(k, "ascending") for k in [*keys, "value"]]

    def first(rows: pa.Table) -> pa.Table:
        return rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start").slice(0, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(names)
        cut: list = [None] * len(names)
        counts = np.zeros((len(names), 2), np.int64)
        for batch in batches:
            for i in range(len(names)):
                values = batch.column(f"v{i}")
                counts[i] += len(values) - values.null_count, values.null_count
                rows = pa.Table.from_arrays([*(batch.column(k) for k in keys), values], [*keys, "value"])
                rows = rows.filter(pc.is_valid(values))
                if cut[i] is not None and rows.num_rows:  # nothing behind the last of enough others counts
                    rows = rows.filter(pc.fill_null(pc.less_equal(rows[keys[0]], cut[i]), True))
                if not rows.num_rows:
                    continue
                held[i] = rows if held[i] is None else pa.concat_tables([held[i], rows])
                if held[i].num_rows > 4 * size:
                    held[i] = first(held[i])
                    cut[i] = held[i][keys[0]][-1] if held[i][keys[0]][-1].is_valid else None
        for i, name in enumerate(names):
            rows = first(held[i]).combine_chunks() if held[i] is not None else None
            if rows is not None:
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([name] * n), *(rows[c].combine_chunks() for c in [*keys, "value"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["column_position", "column_name", *keys, "value", "filled", "missing"])
            if counts[i].any():
                types = [batch.schema.field(k).type for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([name]), *(pa.nulls(1, t) for t in types), pa.nulls(1, pa.string()), *(pa.array([int(x)]) for x in counts[i])], ["column_position", "column_name", *keys, "value", "filled", "missing"])

    return run


def sample(df: DataFrame, order: Column, columns: list[str] | None = None, size: int = SAMPLE) -> DataFrame:
    """``(column_position, column_name, value, rank, filled, missing)``: the first ``size`` non-null values of each column, ``rank`` from 1.

    Rows without a value have counts of values and of nulls instead.  Each partition sends no more than
    ``size`` values of a column; those of many partitions are narrowed again before they come together.
    """
    names = list(columns or df.columns)
    at = df.select(order.alias("at")).schema["at"].dataType
    parts = [F.col("at")[f.name] for f in at.fields] if isinstance(at, T.StructType) else [F.col("at")]
    kinds = [f.dataType for f in at.fields] if isinstance(at, T.StructType) else [at]
    keys = [f"k{i}" for i in range(len(parts))]
    cells = df.select(order.alias("at"), *[_cell(df, n).alias(f"v{i}") for i, n in enumerate(names)]).select(*[c.alias(k) for c, k in zip(parts, keys)], *[f"v{i}" for i in range(len(names))])
    out = T.StructType([T.StructField("column_position", T.IntegerType()), T.StructField("column_name", T.StringType()), *[T.StructField(k, t) for k, t in zip(keys, kinds)], T.StructField("value", T.StringType()), T.StructField("filled", T.LongType()), T.StructField("missing", T.LongType())])
    few = cells.mapInArrow(_narrowing(names, keys, size), out).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for by in (["column_position", "column_name", "part"], ["column_position", "column_name"]):
        counted = F.col("value").isNull()
        few = few.withColumn("rank", F.row_number().over(W.partitionBy(*by, counted).orderBy(*keys, "value"))).where(counted | (F.col("rank") <= size))
    return few.select("column_position", "column_name", "value", F.when(F.col("value").isNotNull(), F.col("rank")).alias("rank"), "filled", "missing")


def _narrowing_cells(key: list[str], size: int):
    """Keeps of each table's column the counts and the first ``size`` non-null values of a partition, in the order of rows and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.Table] = {}
        cut: dict[tuple, int] = {}
        counts: dict[tuple, list[int]] = {}

        def first(cells: pa.Table) -> pa.Table:
            return cells.take(pc.sort_indices(cells, sort_keys=[("row", "ascending"), ("value", "ascending")], null_placement="at_start").slice(0, size))

        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for k in key:
                coded = batch.column(k).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            rows = pc.fill_null(batch.column("row"), np.iinfo(np.int64).min).to_numpy()
            filled = pc.is_valid(batch.column("value")).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if batch.num_rows else []:
                name = tuple(batch.column(k)[at[0]].as_py() for k in key)
                count, there = counts.setdefault(name, [0, 0]), at[filled[at]]
                count[0], count[1] = count[0] + len(there), count[1] + len(at) - len(there)
                if name in cut:  # nothing behind the last of enough others counts
                    there = there[rows[there] <= cut[name]]
                if not len(there):
                    continue
                cells = pa.table([batch.column(c).take(pa.array(there)) for c in ("row", "value")], ["row", "value"])
                held[name] = pa.concat_tables([held[name], cells]) if name in held else cells
                if held[name].num_rows > 4 * size or name not in cut and held[name].num_rows >= size:
                    held[name] = first(held[name]).combine_chunks()
                    last = held[name]["row"][-1].as_py()
                    cut[name] = np.iinfo(np.int64).min if last is None else last
        names = [*key, "row", "value", "filled", "missing"]
        for name, count in counts.items():
            keys = lambda n: [pa.array([x] * n, batch.schema.field(k).type) for k, x in zip(key, name)]  # noqa: E731, B023
            if name in held:
                cells = first(held.pop(name)).combine_chunks()
                n = cells.num_rows
                yield pa.RecordBatch.from_arrays([*keys(n), *(cells[c].combine_chunks() for c in ("row", "value")), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([*keys(1), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), *(pa.array([x]) for x in count)], names)

    return run


def sample_cells(cells: DataFrame, by: list[str], size: int = SAMPLE) -> DataFrame:
    """The same of many tables' cells ``(*by, column_position, column_name, row, value)``.

    A task holds no more than ``4 * size`` values of each column that it has cells of, and sends ``size``.
    """
    key = [*by, "column_position", "column_name"]
    text = cells.select(*key, F.col("row").cast("long").alias("row"), P.normalised(F.col("value")).alias("value"))
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    out = T.StructType([*(T.StructField(k, text.schema[k].dataType) for k in key), *long("row"), T.StructField("value", T.StringType()), *long("filled", "missing")])
    few = text.mapInArrow(_narrowing_cells(key, size), out).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    counted = F.col("value").isNull()
    for part in (["part"], []):
        few = few.withColumn("rank", F.row_number().over(W.partitionBy(*key, *part, counted).orderBy("row", "value"))).where(counted | (F.col("rank") <= size))
    return few.select(*key, "value", F.when(F.col("value").isNotNull(), F.col("rank")).alias("rank"), "filled", "missing")


def statistics(sampled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates and ranges of each column, from what ``sample`` or ``sample_cells`` keeps of it."""
    v = F.col("value")
    rows = sampled.withColumns({"dt": P.datetime(v), "day": P.date(v), "tod": P.time_of_day(v), "dur": P.duration_seconds(v), "num": P.number(v), "clean": P.cleaned_number(v)})
    rate = lambda c: F.avg(F.when(v.isNotNull(), F.when(c, 1.0).otherwise(0.0)))
    hits = {name: rate(v.rlike(shape)) for name, shape in P.SHAPES.items()}
    in_years = rate(F.year("dt").between(2000, 2050)) / F.nullif(rate(F.col("dt").isNotNull()), F.lit(0.0))
    in_day = F.avg(F.when(F.col("dur").isNotNull(), F.when(F.col("dur").between(0, 86400), 1.0).otherwise(0.0)))
    seen = F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("rank", "value")))), lambda x: x["value"])
    return rows.groupBy(*(by or []), "column_position", "column_name").agg(
        F.sum("filled").alias("non_null_count"), F.sum("missing").alias("null_count"), F.nullif(F.count("value"), F.lit(0)).alias("sample_count"), F.countDistinct("value").alias("unique_count"),
        F.avg(F.char_length("value")).alias("avg_strlen"), F.max(F.char_length("value")).alias("max_strlen"),
        *[h.alias(f"hit_{n}") for n, h in hits.items()],
        rate(F.col("dt").isNotNull()).alias("rate_datetime"), rate(F.col("day").isNotNull()).alias("rate_date"), rate(F.col("tod").isNotNull()).alias("rate_time_of_day"),
        rate(F.col("dur").isNotNull()).alias("rate_duration"), rate(P.is_whole(F.col("num"))).alias("rate_integer"), rate(F.col("num").isNotNull()).alias("rate_float"),
        rate(P.boolean(v).isNotNull()).alias("rate_boolean"), rate(v.rlike("[:/T-]")).alias("separator_rate"),
        F.sum(F.when(F.col("num").isNotNull() & F.col("clean").rlike(r"^0\d"), 1).otherwise(0)).alias("leading_zeros"),
        F.sum(F.when(F.col("num").isNotNull(), 1).otherwise(0)).alias("numeric_count"),
        in_years.alias("in_years"), in_day.alias("in_day"),
        F.min("num").alias("numeric_min"), F.max("num").alias("numeric_max"), F.min("dt").alias("datetime_min"), F.max("dt").alias("datetime_max"),
        F.min("dur").alias("duration_min"), F.max("dur").alias("duration_max"), F.slice(F.array_distinct(seen), 1, EXAMPLES).alias("sample_values"),
    )


def _guarded(scores: dict[str, Column]) -> dict[str, Column]:
    """Scores after the rules that hold one type's evidence against another, in their order."""
    c = F.col
    zeros = F.coalesce(c("leading_zeros") / F.nullif(c("numeric_count"), F.lit(0)), F.lit(0.0))
    s = dict(scores)
    s["id_like"] = F.when((zeros >= 0.3) & (c("unique_ratio") > 0.5), F.greatest(s["id_like"], F.lit(0.75))).otherwise(s["id_like"])
    numeric = c("numeric_count") / c("sample_count") >= 0.9
    for low, factor, also in ((0.3, 0.05, numeric), (0.2, 0.1, F.lit(True))):
        for t in ("date", "datetime"):
            s[t] = F.when(also & (c("separator_rate") < low), s[t] * factor).otherwise(s[t])
    s["duration"] = F.when(c("numeric_max") <= 1.2, s["duration"] * 0.1).otherwise(s["duration"])
    sure = s["datetime"] >= 0.85
    for t in ("date", "time_of_day"):
        s[t] = F.when(sure, s[t] * 0.3).otherwise(s[t])
    return s


def scores() -> dict[str, Column]:
    """Each type's score from a column's statistics."""
    c = F.col
    share = lambda x: 0.7 + 0.3 * F.coalesce(x, F.lit(0.0))
    hinted = F.lit(False)
    for hint in DURATION_HINTS:
        hinted = hinted | F.lower(F.trim("column_name")).contains(hint)
    categorical = F.greatest(F.lit(0.0), (0.2 - c("unique_ratio")) / 0.2)
    various = c("unique_ratio") > 0.7
    spread = F.least(F.lit(1.0), (c("unique_ratio") - 0.7) / 0.3)
    return _guarded({
        "datetime": c("rate_datetime") * share(c("in_years")),
        "date": c("rate_date"),
        "time_of_day": c("rate_time_of_day"),
        "duration": F.when((c("rate_duration") >= 0.2) | hinted, c("rate_duration") * share(c("in_day"))).otherwise(0.0),
        "integer": c("rate_integer"),
        "float": c("rate_float"),
        "boolean": F.when(c("rate_boolean") >= 0.9, c("rate_boolean")).otherwise(0.0),
        "categorical": categorical,
        "free_text": F.when(various & (c("avg_strlen") >= 20), spread * F.least(F.lit(1.0), c("avg_strlen") / 40)).otherwise(0.0),
        "id_like": F.when(various & (c("hit_id_like") > 0.6) & (c("avg_strlen") <= 24), spread * c("hit_id_like")).otherwise(0.0),
        "text": 0.15 + 0.1 * (1 - categorical),
    })


def profile(df: DataFrame, order: Column | None = None, columns: list[str] | None = None, size: int = SAMPLE) -> DataFrame:
    """One row per column: its statistics, ``detected_type``, ``confidence`` and ``candidate_scores``.

    Without an order the rows' own order is taken, as far as Spark keeps it.  A column without
    values is ``empty`` with confidence 1.
    """
    return _profiled(statistics(sample(df, F.monotonically_increasing_id() if order is None else order, columns, size)), [])


def profile_cells(cells: DataFrame, by: list[str], size: int = SAMPLE) -> DataFrame:
    """The profiles of many tables' columns in one plan, with the tables' keys ``by`` (see ``sample_cells``)."""
    return _profiled(statistics(sample_cells(cells, by, size), by), by)


def _profiled(found: DataFrame, by: list[str]) -> DataFrame:
    found = found.withColumn("unique_ratio", F.col("unique_count") / F.greatest(F.col("sample_count"), F.lit(1)))
    each = scores()
    found = found.withColumns({f"score_{t}": each[t] for t in TYPES})
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"score_{t}")).alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)]))
    found = found.withColumn("ranked", ranked)
    best, second = -F.col("ranked")[0]["s"], -F.col("ranked")[1]["s"]
    empty = F.col("non_null_count") == 0
    kind = F.when(empty, "empty").otherwise(F.col("ranked")[0]["t"])
    confidence = F.when(empty, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * best + 0.4 * (best - second))))
    keep_if = lambda c, *types: F.when(F.col("detected_type").isin(*types), F.col(c)).alias(c)
    found = found.withColumns({"detected_type": kind, "confidence": confidence})
    return found.select(
        *by, "column_position", "column_name", "detected_type", "confidence", "non_null_count", "null_count",
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"), F.coalesce("unique_ratio", F.lit(0.0)).alias("unique_ratio"),
        F.coalesce("avg_strlen", F.lit(0.0)).alias("avg_strlen"), F.coalesce("max_strlen", F.lit(0)).alias("max_strlen"),
        keep_if("numeric_min", "integer", "float"), keep_if("numeric_max", "integer", "float"), keep_if("datetime_min", "datetime"), keep_if("datetime_max", "datetime"),
        keep_if("duration_min", "duration"), keep_if("duration_max", "duration"), F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        F.create_map(*[x for n in P.SHAPES for x in (F.lit(n), F.col(f"hit_{n}"))]).alias("regex_hits"), F.create_map(*[x for t in TYPES for x in (F.lit(t), F.col(f"score_{t}"))]).alias("candidate_scores"),
    )


def described(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``text``, a column in words, and ``embedding_text``, its name twice with a hint of its type."""
    few = F.transform(F.slice("sample_values", 1, 7), lambda s: F.when(F.char_length(s) > 30, F.concat(F.substring(s, 1, 27), F.lit("..."))).otherwise(s))
    ratio = F.col("unique_ratio")
    variety = F.when(ratio > 0.9, "high cardinality").when(ratio < 0.1, "low cardinality").when(ratio < 0.3, "categorical")
    text = F.concat_ws(
        "; ", F.format_string("%s (%s)", "column_name", "detected_type"), variety, F.when((F.col("unique_count") > 0) & (ratio < 0.3), F.format_string("%d unique values", "unique_count")),
        F.when(F.size(few) > 0, F.concat(F.lit("examples: "), F.array_join(few, ", "))),
        F.when(F.col("numeric_min").isNotNull(), F.concat(F.lit("range "), P.text_number(F.col("numeric_min"), 6), F.lit("-"), P.text_number(F.col("numeric_max"), 6))),
        F.when(F.col("datetime_min").isNotNull(), F.concat(F.lit("range "), F.date_format("datetime_min", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" to "), F.date_format("datetime_max", "yyyy-MM-dd'T'HH:mm:ss"))),
    )
    # What a type's name adds for matching.
    hints = {"time_of_day": "time", "datetime": "datetime timestamp", "date": "date", "integer": "number count", "float": "number decimal", "id_like": "identifier ID", "boolean": "flag yes no"}
    hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in hints.items() for x in kv]), F.col("detected_type"))
    shown = F.when(F.col("detected_type").isin("text", "id_like") & (F.size("sample_values") > 0), F.concat(F.lit("examples: "), F.array_join(F.slice("sample_values", 1, 3), ", ")))
    return profiles.withColumns({"text": text, "embedding_text": F.concat_ws(" ", "column_name", "column_name", hint, shown)})


def table_text(described_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row: the whole table in words; with ``by``, one for each table that has columns."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("column_position", "text"))), lambda x: x["text"])
    whole = F.concat(F.lit("Table with "), F.count("*").cast("string"), F.lit(" columns: "), F.array_join(parts, " | "))
    return described_.groupBy(*(by or [])).agg(F.when(F.count("*") == 0, F.lit("Empty table with no columns")).otherwise(whole).alias("text"))
