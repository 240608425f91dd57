"""Joins of points with the intervals that hold them, by equal keys and bins of time.

An interval is dealt to every bin that it touches and a point to the one bin that it is in, so a pair
meets once, in an equi-join on key and bin: a key with most of the rows is as many groups as it has bins.
Where pairs are only counted, none is made, as their number grows with the square of a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def micros(moment: Column) -> Column:
    """A timestamp, with or without a zone, as whole microseconds."""
    return F.unix_micros(moment.cast("timestamp"))


def overnight(start: Column, end: Column, day: int = 86_400_000_000) -> Column:
    """The end of an interval whose end may be on the next day: one that is not after the start is a day later."""
    return F.when(end <= start, end + F.lit(day)).otherwise(end)


def _dealt(intervals: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, at: Column, width: float) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides with their bins, and when a pair of them is met."""
    bin_of = lambda x: F.floor(x.cast("double") / F.lit(width)).cast("long")
    left = intervals.withColumns({"_low": start.cast("double"), "_high": end.cast("double")})
    bins = F.when(F.col("_low") <= F.col("_high"), F.sequence(bin_of(F.col("_low")), bin_of(F.col("_high"))))
    left = left.withColumn("_bin", F.explode_outer(bins))
    right = points.withColumn("_at", at.cast("double")).where("_at is not null").withColumn("_bin", bin_of(F.col("_at"))).withColumn("_there", F.lit(True))
    return left, right, [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in [*keys, "_bin"]] + [F.col("_r._at").between(F.col("_l._low"), F.col("_l._high"))]


def inside(intervals: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, at: Column, width: float) -> DataFrame:
    """Pairs of an interval and a point of the same ``keys`` that is in it, both ends included.

    ``start`` and ``end`` are numbers of ``intervals``, ``at`` of ``points``; ``width`` is that of a bin, best
    about a usual interval's length.  Columns that both have must be ``keys``.  A null key or time meets
    nothing; an interval that ends before it starts holds nothing.
    """
    left, right, met = _dealt(intervals, points, keys, start, end, at, width)
    both = left.alias("_l").join(right.alias("_r"), met)
    return both.select(*[F.col(f"_l.`{c}`").alias(c) for c in intervals.columns], *[F.col(f"_r.`{c}`").alias(c) for c in points.columns if c not in keys])


def count_inside(intervals: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, at: Column, width: float, by: list[str], name: str = "n") -> DataFrame:
    """Pairs counted by columns of ``intervals``; 0 where no interval of a group holds a point.

    No pair is made: an interval holds the points up to its end less those before its start.  Both are looked up
    among sums along a key's bins, and those along each bin, so neither a group nor a key comes together whole.
    """
    low, high = F.col("_low"), F.col("_high")
    # A bound comes before the points at its own place if it is a start (0), and after them if it is an end (2).
    bounds = F.inline(F.array(F.struct(low.alias("_at"), F.lit(0).alias("_side"), F.lit(-1).alias("_sign")), F.struct(high.alias("_at"), F.lit(2).alias("_side"), F.lit(1).alias("_sign"))))
    ends = intervals.select(*dict.fromkeys([*keys, *by]), start.cast("double").alias("_low"), end.cast("double").alias("_high"))
    holds = F.coalesce(low <= high, F.lit(False))
    ends = ends.select(*dict.fromkeys([*keys, *by]), holds.alias("_holds"), bounds)
    places = points.select(*keys, at.cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(1).cast("long").alias("_n"))
    places = places.unionByName(ends.select(*keys, "_at", "_side", F.lit(0).cast("long").alias("_n")))
    places = places.withColumn("_bin", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    for c in [*keys, "_at", "_bin"]:  # as joins would ask for, so that both uses of the groups are one exchange
        places = places.where(F.col(c).isNotNull())
    places = places.groupBy(*keys, "_bin", "_at", "_side").agg(F.sum("_n").alias("_n"))
    along = W.partitionBy(*keys, "_bin").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = places.withColumn("_within", F.sum("_n").over(along)).where("_side <> 1").drop("_n")
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = places.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sums = within.join(bins, [*keys, "_bin"]).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_at").alias("_place"), F.col("_side").alias("_which"), (F.col("_within") + F.col("_before")).alias("_upto"))
    met = [F.col(k) == F.col(f"_key{i}") for i, k in enumerate(keys)] + [F.col("_at") == F.col("_place"), F.col("_side") == F.col("_which"), F.col("_holds")]
    return ends.join(sums, met, "left").groupBy(*by).agg(F.sum(F.coalesce(F.col("_sign") * F.col("_upto"), F.lit(0))).alias(name))
