"""Clusters of times of day.

Minutes of a day have at most 1440 values, so their histogram is small whatever the table; on it
the best one-dimensional k-means is found exactly, and its labels are joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import clock, minutes_of_day, rounded

#: First minute and name of each band of the day (fixed values).
BANDS = [(0, "NIGHT"), (300, "MORNING"), (540, "MID_DAY"), (780, "AFTERNOON"), (1020, "EVENING"), (1260, "NIGHT")]
#: Parts of the day for ``enrich`` by rule: first minute, minute behind the last; what is in none is in a fourth one (fixed values).
PARTS = [(300, 720), (720, 1020), (1020, 1260)]
#: A start so many minutes from its cluster's centre has no confidence.
REACH = 120.0


def band(minutes: Column) -> Column:
    """The name of the band that a minute of the day is in."""
    out = F.lit(BANDS[0][1])
    for start, name in BANDS[1:]:
        out = F.when(F.floor(minutes) >= start, F.lit(name)).otherwise(out)
    return F.when(minutes.isNotNull(), out)


def best_clusters(values: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, float, float]]:
    """``(least, most, centre)`` of the ``k`` clusters of ascending values with the least squared distances."""
    n = len(values)
    k = min(k, n)
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights * values, weights * values**2))

    def cost(i: np.ndarray, j: int) -> np.ndarray:  # of values i..j
        total = s[j + 1] - s[i]
        return q[j + 1] - q[i] - total * total / (w[j + 1] - w[i])

    best = np.array([cost(np.array([0]), j)[0] for j in range(n)])
    starts = [np.zeros(n, int)]
    for _ in range(1, k):
        new, at = best.copy(), np.zeros(n, int)
        for j in range(1, n):
            i = np.arange(1, j + 1)
            total = best[i - 1] + cost(i, j)
            m = int(np.argmin(total))
            new[j], at[j] = total[m], i[m]
        best = new
        starts.append(at)
    out, j = [], n - 1
    for at in reversed(starts):
        i = int(at[j])
        out.append((float(values[i]), float(values[j]), float((s[j + 1] - s[i]) / (w[j + 1] - w[i]))))
        if i == 0:
            break
        j = i - 1
    return out[::-1]


def clusters(minutes: DataFrame) -> list[tuple[float, float, float]]:
    """Clusters of the column ``minute``: up to four, half as many as rows, no more than different values."""
    rows = minutes.where("minute is not null").groupBy("minute").count().orderBy("minute").collect()
    n = sum(r["count"] for r in rows)
    if n < 2:
        return []
    return best_clusters(np.array([r["minute"] for r in rows], float), np.array([r["count"] for r in rows], float), max(1, min(4, n // 2)))


def day_parts(minutes: DataFrame) -> list[tuple[int, int, float]]:
    """``(minute, part, centre)`` of all minutes in the parts of the day that the column ``minute`` has; a centre is the mean of a part's rows."""
    part = F.lit(len(PARTS))
    for i, (low, high) in enumerate(PARTS):
        part = F.when((F.col("minute") >= low) & (F.col("minute") < high), F.lit(i)).otherwise(part)
    rows = minutes.where("minute is not null").groupBy(part.alias("part")).agg(F.avg("minute").alias("centre"), F.count("*").alias("n")).collect()
    if sum(r["n"] for r in rows) < 2:
        return []
    centre = {r["part"]: r["centre"] for r in rows}
    of = [next((i for i, (low, high) in enumerate(PARTS) if low <= m < high), len(PARTS)) for m in range(1440)]
    return [(m, i, centre[i]) for m, i in enumerate(of) if i in centre]


def enrich(df: DataFrame, start: str = "shift_start", by_rule: bool = False) -> DataFrame:
    """``df`` with the minute of its start, its cluster by ascending centre, the cluster's name, and how sure it is.

    By rule the clusters are four fixed parts of the day, named after the mean of their starts, and every
    readable start is sure.  Fewer than two readable starts, or an unreadable one: UNKNOWN, -1 and 0.
    """
    new = ["shift_start_minutes", "shift_cluster_id", "detected_shift_type", "shift_detection_confidence", "shift_detection_evidence"]
    rows = df.withColumn("_minute", minutes_of_day(F.col(start).cast("string"))).drop(*new)
    starts = rows.select(F.col("_minute").alias("minute"))
    # A minute's cluster is looked up: the join keeps the reading of a start and what follows from it apart.
    minutes = day_parts(starts) if by_rule else [(m, i, mid) for i, (low, high, mid) in enumerate(clusters(starts)) for m in range(int(low), int(high) + 1)]
    known = df.sparkSession.createDataFrame(minutes, "_at int, shift_cluster_id int, centre double")
    sure = F.lit(1.0) if by_rule else rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("_at") - F.col("centre")) / REACH)), 2)
    centre = F.col("centre")
    said = F.format_string("start %s is in the %s cluster around %s", clock(F.col("_at")), band(centre), clock(centre))
    known = known.select("_at", "shift_cluster_id", band(centre).alias("detected_shift_type"), sure.alias("shift_detection_confidence"), said.alias("shift_detection_evidence"))
    out = rows.join(F.broadcast(known), F.col("_minute") == F.col("_at"), "left").drop("_at")
    return out.withColumnRenamed("_minute", "shift_start_minutes").fillna({"shift_cluster_id": -1, "detected_shift_type": "UNKNOWN", "shift_detection_confidence": 0.0, "shift_detection_evidence": "no readable start, or too few"})


def patterns(df: DataFrame, start: str = "shift_start", end: str = "shift_end") -> DataFrame:
    """Count, median start and mean duration of each cluster of an enriched table; a shift that ends before it starts ends a day later."""
    hours = (minutes_of_day(F.col(end).cast("string")) - F.col("shift_start_minutes")) / 60
    hours = F.when(hours > 0, hours).otherwise(hours + 24)
    return df.where("shift_cluster_id >= 0").groupBy("shift_cluster_id", "detected_shift_type").agg(F.count("*").alias("shifts"), F.median("shift_start_minutes").alias("median_start"), rounded(F.avg(hours), 2).alias("mean_hours"))
