"""Packing of texts of unlike lengths into padded batches.

Lengths are counted into one histogram; dynamic programming over all of its lengths finds the bucket
bounds with the least padding; inside each bucket consecutive texts make batches of one token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, materialise

BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 65_536
#: Texts are numbered in parts of about so many.
PART_ROWS = 1 << 20


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a text: where one begins; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]++")), F.lit(0)).cast("long")


def best_bounds(longest: list[int], count: list[int], buckets: int) -> list[int]:
    """The bucket bounds (largest lengths) with the least padding, exactly.

    ``longest`` has the different lengths, ascending; ``count`` the texts of each.  Padding only depends
    on what a bucket's texts are padded to, so a bucket of lengths i+1..j costs longest[j] times its
    texts.  The best split before j is the lowest at longest[j] of lines with slopes that fall, one
    for each i; both only move to the right, so a bucket more takes one walk over the lengths.
    """
    n = len(longest)
    if not n:
        return []
    before = [0]
    for c in count:
        before.append(before[-1] + int(c))
    # cost[j]: of the first j lengths; each choice says where the last bucket begins, or -1 where one bucket more is of no use.
    cost, choices = [0, *(int(x) * c for x, c in zip(longest, before[1:]))], []
    for _ in range(1, min(buckets, n)):
        new, at, hull, top = cost[:], [-1] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if i:  # the line of i: cost[i] - x * before[i]
                while len(hull) - top >= 2 and _covered(cost, before, hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            top = min(top, max(len(hull) - 1, 0))
            x = int(longest[j - 1])
            while top + 1 < len(hull) and cost[hull[top + 1]] - x * before[hull[top + 1]] <= cost[hull[top]] - x * before[hull[top]]:
                top += 1
            if hull and (split := cost[hull[top]] + x * (before[j] - before[hull[top]])) < cost[j]:
                new[j], at[j] = split, hull[top]
        choices.append(at)
        cost = new
    bounds, j = [], n
    for at in reversed(choices):
        if at[j] >= 0:
            bounds.append(int(longest[j - 1]))
            j = at[j]
    return sorted([*bounds, int(longest[j - 1])])


def _covered(cost: list[int], before: list[int], a: int, b: int, c: int) -> bool:
    """Whether the line of ``b`` is nowhere below both those of ``a`` and ``c``."""
    return (cost[c] - cost[a]) * (before[b] - before[a]) <= (cost[b] - cost[a]) * (before[c] - before[a])


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``doc_id, n_tokens, bucket_len, batch_id, place`` for each row of ``docs`` with a length above 0.

    ``length`` defaults to the words of ``text``.  ``bucket_len`` is the length that a text is padded
    to, ``batch_id`` names a batch and ``place`` counts in it from 0.  A batch holds as many texts as
    the budget has room for at that length, one at least; a bucket's last batch may hold fewer.
    Texts without tokens, null ones included, are in no batch: bucket, batch and place are null.
    """
    sized = docs.select("doc_id", (words(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("n_tokens"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    full = sized.where("n_tokens > 0")
    # One row for each different length.  If there are D of them, there are D * D / 2 tokens at least: even 10^13 tokens have under 5 million.
    table = full.groupBy("n_tokens").agg(F.count("*").alias("count")).orderBy("n_tokens").toPandas()
    bounds = best_bounds(table["n_tokens"].tolist(), table["count"].tolist(), buckets)
    parts = 1 + int(table["count"].sum()) // PART_ROWS
    if not bounds:
        return sized.select("doc_id", "n_tokens", F.lit(None).cast("long").alias("bucket_len"), F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("long").alias("place"))
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("long")
    # Rows are dealt by their own number, as ids may be null or repeated.
    numbered = full.withColumn("bucket_len", bucket).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    within = F.row_number().over(W.partitionBy("bucket_len", "part").orderBy("doc_id", "n_tokens", "row"))
    counts = numbered.groupBy("bucket_len", "part").count()
    offsets = counts.select("bucket_len", "part", (F.sum("count").over(W.partitionBy("bucket_len").orderBy("part")) - F.col("count")).alias("before"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    # One row for each bucket and part: broadcast if they are few.
    few = F.broadcast(offsets) if parts * len(bounds) <= BROADCAST_ROWS else offsets
    placed = numbered.withColumn("rank", within).join(few, ["bucket_len", "part"]).withColumn("at", F.col("before") + F.col("rank") - 1)
    batch = F.concat_ws("-", F.col("bucket_len"), F.floor(F.col("at") / room).cast("long"))
    out = placed.select("doc_id", "n_tokens", "bucket_len", batch.alias("batch_id"), (F.col("at") % room).alias("place"))
    none = sized.where("n_tokens = 0").select("doc_id", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket_len", "long"), ("batch_id", "string"), ("place", "long"))])
    return out.unionByName(none)
