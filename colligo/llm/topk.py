"""Exact top-k by inner product, a block of candidates at a time.

Every dimension of a vector is two terms, one for its positive and one for its negative values.
Candidates are sorted by their strongest term where they lie, so that vectors of a range are alike,
and cut into ranges of blocks.  A block knows the maximum of each term.  For a query the blocks are
ordered by the sum of its weights times those maxima; they are scored through their own vectors until
that bound falls below the query's k-th score.  What a k-th score is at least is found among the
queries themselves first, for all tasks; what a task learns beyond that helps it with later ranges.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise
from .vectors import NONE, PACKED, Block, packing, scores, sound, strongest, unpacked

#: Vectors of a block, of a range, and queries that are looked at together.
BLOCK, RANGE, QUERIES = 128, 4096, 256
#: Blocks of queries whose best scores a task remembers at once.
REMEMBERED = 1024
SCALE = 1024

_FOUND = "query_id long, vec_id long, score long"


def best_in_range(q: Block, c: Block, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query's place, candidate's id, score)`` of what may be among the best of each query.

    The queries' extra number: what each one's k-th score is at least; ``top``: the k best scores that each
    query has met so far, which are brought up to date.
    """
    k, starts, rows, least = top.shape[1], np.arange(0, len(c), BLOCK), [], q.extra[:, 0]
    width = min(q.numbers.shape[1], c.numbers.shape[1])
    weights, values = q.sizes()[:, :width], c.sizes()[:, :width]
    with np.errstate(over="ignore"):
        high, low = (np.maximum(np.maximum.reduceat(x, starts, axis=0), 0) for x in (values, -values))
        bounds = np.ceil((np.maximum(weights, 0) @ high.T + np.maximum(-weights, 0) @ low.T) * (1 + 1e-12))
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth, alive = np.maximum(least, top.min(1)), np.arange(len(q))
    # Every query takes the blocks in the order of its own bounds; those whose next block is the same are scored together.
    for step in range(len(starts)):
        alive = alive[bounds[alive, order[alive, step]] >= kth[alive]]
        for b in np.unique(order[alive, step]).tolist():
            own, block = alive[order[alive, step] == b], c.part(slice(starts[b], starts[b] + BLOCK))
            names, got = block.ids, scores(q.part(own), block)
            fit = (got >= kth[own, None]) & (names != q.ids[own, None])
            at, to = np.nonzero(fit)
            if len(at):
                rows.append((own[at], names[to], got[at, to]))
                both = np.concatenate([top[own], np.where(fit, got, NONE)], 1)
                top[own] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                kth[own] = np.maximum(least[own], top[own].min(1))
    who, names, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*rows) if rows else ((), (), ())))
    fit = score >= kth[who]
    who, names, score = who[fit], names[fit], score[fit]
    sort = np.lexsort((names, -score, who))
    who, names, score = who[sort], names[sort], score[sort]
    near = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[near], names[near], score[near]


def _search(k: int):
    columns = ["ids", "width", "kind", "numbers", "extra", "huge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            table = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for r, name in enumerate(table["block"]):
                q, c = (unpacked(*(table[f"{side}{x}"][r] for x in columns), SCALE) for side in ("q_", ""))
                top = tops.pop(name, None)
                if top is None:
                    top = np.full((len(q), k), NONE)
                    if len(tops) >= REMEMBERED:
                        tops.popitem(last=False)
                tops[name] = top
                who, found, score = best_in_range(q, c, top)
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[who]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query, ties to the smaller id.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` says which rows are queries.  Every row
    is a candidate but those with the query's own id.  Rows with a null id, or whose vector is null,
    or has components that are null or not finite, take no part.  A shorter vector counts as one with
    zeros behind it.  A repeated query row counts once if it repeats its vector too.  Scores are exact
    whatever the components; those beyond 64 bits are told as the last number that fits.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    unknown = F.lit(None).cast("long").alias("least")
    # Sorted inside their partitions: nothing is shuffled, and no term is all in one task.  A block is as wide as its own longest vector.
    alike = rows.withColumns({"width": F.size("embedding"), "term": strongest(F.col("embedding"))}).sortWithinPartitions("width", "term")
    ranges = materialise(alike.select("vec_id", "embedding").mapInArrow(packing(RANGE, SCALE), PACKED), "ranges")
    once = materialise(rows.where("is_query").select("vec_id", "embedding").distinct(), "queries")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(asked: DataFrame, among: DataFrame) -> DataFrame:
        blocks = asked.withColumnsRenamed({c: f"q_{c}" for c in asked.columns}).withColumn("block", F.monotonically_increasing_id())
        # Blocks of the stated queries against ranges.  The queries are a table of known size, which Spark broadcasts only if it is small.
        return blocks.crossJoin(among).mapInArrow(_search(k), _FOUND).withColumn("rank", rank).where(F.col("rank") <= k)

    packed = lambda df: materialise(df.withColumn("width", F.size("embedding")).sortWithinPartitions("width").select("vec_id", "embedding", "least").mapInArrow(packing(QUERIES, SCALE, 1), PACKED), "asked")
    asked = packed(once.withColumn("least", unknown))
    kth = materialise(best(asked, asked).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")), "kth")
    discard(asked)
    asked = packed(once.join(kth, "vec_id", "left"))
    discard(once, kth)
    return best(asked, ranges).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
           FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
