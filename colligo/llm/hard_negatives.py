"""Hard negatives by bounds from summaries of vector segments.

A vector is cut into short segments, each stored with its mean and its deviation (the norm of what
is left without the mean).  Of two segments of ``n`` coordinates the inner product is ``n`` times the
means' product, give or take the deviations' product; summed up, that bounds the score of two vectors.
Segments are merged to longer ones, whose summaries follow from those of their parts, so a pair is
first bounded by its longest segments, then by ever shorter ones, and scored only if no bound decides it.

First every anchor meets the vectors of its own label and keeps the best, its positives.  Each positive
then gives a window of scores, and every anchor meets the vectors of other labels for the best in each.
What is among the best so far, in a task, narrows what later blocks are asked for.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise
from .vectors import MOST, NONE, PACKED, SEGMENT, Block, packing, pair_products, pair_scores, scores, sound, strongest, unpacked

SCALE = 256
#: Vectors that are looked at together: anchors, others.
ANCHORS, RANGE = 256, 4096
#: Blocks of anchors whose best scores a task remembers.
REMEMBERED = 1024
#: Parts that the vectors of a label are dealt to.
SALTS = 32
#: Segments are merged so many at a time from one level to the one above; pairs are listed once so small a share of them is left.
_MERGED, _SPARSE = 4, 1 / 8
#: Bounds are in single precision: what they may be wrong by, in products of norms.  Vectors beyond _WILD are always scored.
_SLACK, _WILD = 1e-5, 1e15


def summaries(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the shortest segments, the last one filled up with zeros."""
    n, width = numbers.shape
    count = -(-width // SEGMENT)
    padded = np.zeros((n, count * SEGMENT))
    padded[:, :width] = numbers
    parts = padded.reshape(n, count, SEGMENT)
    means = parts.mean(2)
    return means.astype(np.float32), np.sqrt(((parts - means[:, :, None]) ** 2).sum(2)).astype(np.float32)


def levels(means: np.ndarray, deviations: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means (times the root of the segment's length) and deviations by level, the longest segments first."""
    out, length = [], SEGMENT
    while True:
        out.append((means * np.float32(length**0.5), deviations))
        if means.shape[1] <= 1:
            return out[::-1]
        fill = -means.shape[1] % _MERGED
        means, deviations = (np.pad(x, ((0, 0), (0, fill))).reshape(len(x), -1, _MERGED) for x in (means, deviations))
        merged = means.mean(2)
        deviations = np.sqrt((deviations**2).sum(2) + length * ((means - merged[:, :, None]) ** 2).sum(2))
        means, length = merged, length * _MERGED


def _refined(q: Block, c: Block, of_q: tuple, of_c: tuple, allowed: np.ndarray, fits: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Allowed pairs ``(i, j, score)`` whose bounds ``fits(low, high, i)`` on every level; ``i`` is None for all rows."""
    shared = min(of_q[0].shape[1], of_c[0].shape[1])
    wild_q, wild_c = (x.norms > _WILD for x in (q, c))
    for wild, block in ((wild_q, q), (wild_c, c)):
        wild[list(block.huge)] = True
    slack, i, j = np.float32(_SLACK), None, None
    with np.errstate(over="ignore", invalid="ignore"):
        norms_q, norms_c = ((x.norms + 1).astype(np.float32) for x in (q, c))
        for (mq, dq), (mc, dc) in zip(*(levels(m[:, :shared], d[:, :shared]) for m, d in (of_q, of_c))):
            if i is None:
                middle, about = mq @ mc.T, dq @ dc.T + slack * np.outer(norms_q, norms_c)
                allowed &= fits(middle - about, middle + about, None) | wild_q[:, None] | wild_c
                if allowed.mean() < _SPARSE:
                    i, j = np.nonzero(allowed)
            else:
                middle, about = pair_products(mq, mc, i, j), pair_products(dq, dc, i, j) + slack * norms_q[i] * norms_c[j]
                kept = fits(middle - about, middle + about, i) | wild_q[i] | wild_c[j]
                i, j = i[kept], j[kept]
    if i is None:
        i, j = np.nonzero(allowed)
        return i, j, scores(q, c)[i, j]
    return i, j, pair_scores(q, c, i, j)


def _best(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each, ties to the smaller id."""
    order = np.lexsort((ids, -score, who))
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who) < k]


def windows(positive: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The scores from ``least`` to ``most`` hundredths of each positive's, as whole numbers; none where there is no positive."""
    a, r = positive // 100, positive % 100
    low, high = least * a - (-least * r // 100), most * a + most * r // 100
    gone = positive == NONE
    return np.where(gone, MOST, low), np.where(gone, NONE, high)


def _positives(q: Block, c: Block, of_q: tuple, of_c: tuple, top: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    k, kth = top.shape[2], top[:, 0].min(1).astype(float)

    def fits(low: np.ndarray, high: np.ndarray, i: np.ndarray | None) -> np.ndarray:
        return high >= (kth[:, None] if i is None else kth[i])

    i, j, score = _refined(q, c, of_q, of_c, q.extra[:, :1] != c.ids, fits)
    found = _best(i, c.ids[j], score, k)
    yield 0, i[found], c.ids[j[found]], score[found]


def _negatives(least: int, most: int):
    def run(q: Block, c: Block, of_q: tuple, of_c: tuple, top: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        k = top.shape[2]
        low, high = windows(q.extra[:, 2:], least, most)
        low = np.maximum(low, top.min(2))
        near, far = low.astype(float), high.astype(float)

        def fits(least_score: np.ndarray, most_score: np.ndarray, i: np.ndarray | None) -> np.ndarray:
            if i is None:
                return (most_score >= near.min(1)[:, None]) & (least_score <= far.max(1)[:, None])
            return ((most_score[:, None] >= near[i]) & (least_score[:, None] <= far[i])).any(1)

        other = (q.extra[:, 1:2] != c.extra[:, 0]) & (q.extra[:, :1] != c.ids)
        i, j, score = _refined(q, c, of_q, of_c, other, fits)
        for window in range(low.shape[1]):
            into = (score >= low[i, window]) & (score <= high[i, window])
            who, ids, own = i[into], c.ids[j[into]], score[into]
            found = _best(who, ids, own, k)
            yield window, who[found], ids[found], own[found]

    return run


def _search(find: Callable, windows_: int, k: int):
    """Every block of anchors against every range that it is joined with."""
    columns = ["ids", "width", "kind", "numbers", "extra", "huge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            table = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for r, name in enumerate(table["block"]):
                sides = []
                for side in ("q_", ""):
                    block = unpacked(*(table[f"{side}{c}"][r] for c in columns), SCALE)
                    means, deviations = (np.frombuffer(table[f"{side}{c}"][r], np.float32).reshape(len(block), -1) for c in ("means", "deviations"))
                    sides.append((block, (means, deviations)))
                (q, of_q), (c, of_c) = sides
                top = tops.pop(name, None)
                if top is None:
                    top = np.full((len(q), windows_, k), NONE)
                    if len(tops) >= REMEMBERED:
                        tops.popitem(last=False)
                tops[name] = top
                for window, who, ids, score in find(q, c, of_q, of_c, top):
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    new = np.full((len(q), k), NONE)
                    new[who, place] = score
                    top[:, window] = np.partition(np.concatenate([top[:, window], new], 1), k, axis=1)[:, k:]
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[who]), pa.array(np.full(len(who), window, np.int32)), pa.array(ids), pa.array(score)], ["anchor", "window", "vec_id", "score"])

    return run


_FOUND = "anchor long, window int, vec_id long, score long"
_SUMMED = f"{PACKED}, label long, means binary, deviations binary"


def _packed(size: int, extras: int):
    """Packs rows of one label, with the summaries of their segments."""
    pack = packing(size, SCALE, extras, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in pack(batches):
            row = packed.to_pylist()[0]
            block = unpacked(*(row[c] for c in ("ids", "width", "kind", "numbers", "extra", "huge")), SCALE)
            both = [pa.array([x.tobytes()], pa.binary()) for x in summaries(block.numbers)]
            yield pa.RecordBatch.from_arrays([*packed.columns, *both], [*packed.schema.names, "means", "deviations"])

    return run


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label`` (or the column given).  Each of the rows that
    ``anchors`` tells is held against all rows.  Its positives are the best ``positives`` rows of its label;
    for each of them come the best ``negatives`` rows of other labels whose score is from ``least`` to
    ``most`` hundredths of the positive's.  Ties go to the smaller id.

    Rows with a null id or label take no part, nor do those whose vector is null or has components that are
    null or not finite.  A row with the anchor's own id is neither positive nor negative.  A shorter vector
    counts as one with zeros behind it.  Repeated rows count as often as they occur; a repeated anchor, and a
    repeated positive of it, give their rows once.  Scores beyond 64 bits are told as the last number that fits.
    """
    own = F.col("label") if label is None else label
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", own.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("embedding")))
    alike = rows.select("vec_id", "embedding", "label").withColumn("width", F.size("embedding")).withColumn("term", strongest(F.col("embedding")))
    ranges = alike.sortWithinPartitions("label", "width", "term").select("vec_id", "embedding", "label")
    ranges = materialise(ranges.mapInArrow(_packed(RANGE, 1), _SUMMED), "ranges")
    once = materialise(rows.where("is_anchor").select("vec_id", "embedding", "label").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    def asked(found: DataFrame, columns: list[str]) -> DataFrame:
        """Blocks of anchors, whose extra numbers are their ids, labels and ``columns``."""
        own = found.withColumn("width", F.size("embedding")).sortWithinPartitions("label", "width")
        own = own.select(F.col("anchor").alias("vec_id"), "embedding", F.col("vec_id").alias("id"), "label", *columns)
        out = materialise(own.mapInArrow(_packed(ANCHORS, 2 + len(columns)), _SUMMED), "asked")
        return out.withColumnsRenamed({c: f"q_{c}" for c in out.columns}).withColumn("block", F.monotonically_increasing_id()), out

    def first(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    # Anchors go to every part of their label; a label's vectors are dealt to SALTS parts, as it may hold most rows.
    blocks, asked_first = asked(once, [])
    part = F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")
    dealt = blocks.withColumn("label", F.col("q_label")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt.join(ranges.withColumn("part", part), ["label", "part"])
    best = first(met.mapInArrow(_search(_positives, 1, positives), _FOUND), positives).groupBy("anchor").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))
    scored = [f"score_{k}" for k in range(positives)]
    known = once.join(best, "anchor").withColumns({c: -F.get("best", F.lit(k)).getField("minus") for k, c in enumerate(scored)})
    known = materialise(known, "known")
    discard(asked_first)
    blocks, asked_then = asked(known, scored)
    # Blocks of the stated anchors against ranges.  The anchors are a table of known size, which Spark broadcasts only if it is small.
    found = blocks.crossJoin(ranges).mapInArrow(_search(_negatives(least, most), positives, negatives), _FOUND)
    positive = known.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("best").alias("window", "p"))
    out = first(found, negatives).join(positive, ["anchor", "window"])
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), (-F.col("p.minus")).alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
     s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                  CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
           FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
