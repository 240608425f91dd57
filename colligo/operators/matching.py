"""Nearest neighbours, votes and scores that match a table and its columns to target schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.compatibility import compatibility
from ..functions.parsing import rounded, snake

#: Weights of a document type's score, a column's least confidence, and the least lead over the second.
WEIGHTS = {"document": 0.3, "column": 0.5, "coverage": 0.2}
ACCEPT, GAP, COVERED = 0.82, 0.01, 0.5
#: Small sides of at most so many rows go to every task; larger ones are joined like any table.
BROADCAST_ROWS = 10_000
#: Queries and items of a block, and the most blocks of queries that go to every task (4096 queries, 32 MB at 1024 dimensions).
QUERIES, ITEMS, BROADCAST_BLOCKS = 256, 4096, 16


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has no more than ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _packed(size: int, key: str):
    """Packs rows with a ``vector``: the other columns, and the vectors scaled to unit length.  Null, incomplete and zero vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                vectors = [v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else None for v in part.column("vector")]
                there = [v is not None and 0 < np.linalg.norm(v) < np.inf for v in vectors]
                if not any(there):
                    continue
                vectors, rows = [v / np.linalg.norm(v) for v, ok in zip(vectors, there) if ok], part.drop_columns(["vector"]).filter(pa.array(there))
                width, sink = max(map(len, vectors)), pa.BufferOutputStream()
                flat = np.zeros((len(vectors), width))
                for at, v in enumerate(vectors):
                    flat[at, : len(v)] = v
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([np.array([len(v) for v in vectors], np.int64).tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], [f"{key}_rows", f"{key}_sizes", f"{key}_vectors"])

    return run


def _closest(k: int, digits: int, fields: list[str]):
    """The ``k`` most similar items of each query of a block, of each pair of packed blocks."""

    def unpacked(rows: pa.Buffer, sizes: pa.Buffer, vectors: pa.Buffer):
        n = np.frombuffer(sizes, np.int64)
        return pa.ipc.open_stream(rows).read_all().combine_chunks(), n, np.frombuffer(vectors).reshape(len(n), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # blocks are read where the batch has them, not copied
                (asked, n, q), (items, m, v) = (unpacked(*(batch.column(f"{x}_{c}")[i].as_buffer() for c in ("rows", "sizes", "vectors"))) for x in "qi")
                width = min(q.shape[1], v.shape[1])
                scaled = q[:, :width] @ v[:, :width].T
                scaled *= 10.0**digits
                near = np.abs(scaled)
                near += 0.5
                np.floor(near, out=near)
                near *= np.sign(scaled, out=scaled)
                near /= 10.0**digits
                near += 0.0
                near[n[:, None] != m] = -np.inf  # vectors of unlike lengths have no similarity
                by_id = np.empty(len(m), np.int64)
                by_id[pc.sort_indices(items["item_id"]).to_numpy()] = np.arange(len(m))
                most = min(k, len(m))
                least = np.partition(near, len(m) - most, axis=1)[:, len(m) - most]
                who, whom = [], []
                for row in range(len(n)):
                    at = np.flatnonzero((near[row] >= least[row]) & np.isfinite(near[row]))
                    at = at[np.lexsort((by_id[at], -near[row, at]))[:k]]
                    who += [row] * len(at)
                    whom += at.tolist()
                found = items.take(whom).append_column("query_id", asked["query_id"].take(who)).append_column("similarity", pa.array(near[who, whom]))
                yield from found.select(fields).to_batches()

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """The ``k`` items of the highest cosine for each query, ``rank`` from 1, ties to the smaller item.

    ``queries``: query_id, vector; ``items``: item_id, vector and whatever else they carry.  Vectors are
    scaled to unit length once; blocks of the stated queries meet blocks of items, and each meeting
    gives its ``k`` best.  Null, incomplete and zero vectors, and pairs of unlike lengths, have no similarity.
    """
    packed = lambda df, key, size: df.mapInArrow(_packed(size, key), f"{key}_rows binary, {key}_sizes binary, {key}_vectors binary")
    double = F.col("vector").cast("array<double>").alias("vector")
    carried = [c for c in items.columns if c != "vector"]
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *[items.schema[c] for c in carried], T.StructField("similarity", T.DoubleType())])
    asked = bounded(packed(queries.select("query_id", double), "q", QUERIES), BROADCAST_BLOCKS)
    found = packed(items.select(*carried, double), "i", ITEMS).crossJoin(asked).mapInArrow(_closest(k, digits, schema.names), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("item_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, label: str) -> DataFrame:
    """``query_id``, the label with the most similarity, and its share as ``confidence``; ties to the smaller label."""
    sums = neighbours.groupBy("query_id", label).agg(F.sum("similarity").alias("weight"))
    best = sums.groupBy("query_id").agg(F.sum("weight").alias("total"), F.min(F.struct((-F.col("weight")).alias("w"), F.col(label).alias("label"))).alias("best"))
    return best.select("query_id", F.col("best.label").alias(label), rounded(-F.col("best.w") / F.nullif("total", F.lit(0.0)), 3).alias("confidence"))


def mapping_vote(neighbours: DataFrame) -> DataFrame:
    """``source_column, target_field, confidence``: the target that similar tables mapped a column to.

    ``neighbours``: similarity, column_mappings (a map).
    """
    each = neighbours.select("similarity", F.explode("column_mappings").alias("source_column", "target_field"))
    sums = each.groupBy("source_column", "target_field").agg(F.sum("similarity").alias("weight"))
    best = sums.groupBy("source_column").agg(F.sum("weight").alias("total"), F.min(F.struct((-F.col("weight")).alias("w"), F.col("target_field").alias("t"))).alias("best"))
    return best.select("source_column", F.col("best.t").alias("target_field"), rounded(-F.col("best.w") / F.nullif("total", F.lit(0.0)), 3).alias("confidence"))


def similar_columns(columns: DataFrame, known: DataFrame, k: int = 5, vertical: str | None = None, document_type: str | None = None) -> DataFrame:
    """The ``k`` known mappings whose column is most similar to each column, ``rank`` from 1, of one vertical or document type if named.

    ``columns``: query_id, vector; ``known``: vertical, document_type, source_column, target_field, occurrence_count, vector.
    Ties go to the mapping that comes first by its names.
    """
    for name, value in (("vertical", vertical), ("document_type", document_type)):
        if value is not None:
            known = known.where(F.col(name) == F.lit(value))
    return nearest(columns, known.withColumn("item_id", F.to_json(F.array("vertical", "document_type", "source_column", "target_field"))), k).drop("item_id")


def column_suggestions(columns: DataFrame, voted: DataFrame, similar: DataFrame) -> DataFrame:
    """``source_column, target_field, confidence, origin, matched_column``: for each column the surer of two suggestions.

    ``columns``: source_column; ``voted``: what similar tables mapped it to (``mapping_vote``); ``similar``:
    source_column, target_field, similarity, rank, matched_column of known columns.  A column's own
    neighbour counts only if it is surer than the vote; without either there is no target and confidence 0.
    """
    vote_ = voted.select("source_column", F.col("target_field").alias("v_target"), F.col("confidence").alias("v"))
    near = similar.where("rank = 1").select("source_column", F.col("target_field").alias("n_target"), rounded("similarity", 3).alias("n"), "matched_column")
    both = columns.select("source_column").join(vote_, "source_column", "left").join(near, "source_column", "left")
    own = F.coalesce(F.col("n") > F.coalesce("v", F.lit(0.0)), F.lit(False))
    pick = lambda a, b: F.when(own, a).otherwise(b)
    origin = F.when(own, "column_similarity").when(F.col("v").isNotNull(), "similar_tables").otherwise("no_match")
    return both.select("source_column", pick(F.col("n_target"), F.col("v_target")).alias("target_field"), pick(F.col("n"), F.coalesce("v", F.lit(0.0))).alias("confidence"), origin.alias("origin"), F.when(own, F.col("matched_column")).alias("matched_column"))


def adjusted(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Column-to-field matches with their similarity times the types' fit, ranked anew.

    Here and below ``by`` are the keys of many tables, each of which is scored on its own.
    ``matches``: by, column_position, column_name, detected_type, document_type, field_name, field_type, similarity.
    """
    fit = compatibility(F.col("detected_type"), F.col("field_type"))
    out = matches.withColumn("compatibility", fit).withColumn("adjusted", F.col("similarity") * F.col("compatibility"))
    order = W.partitionBy(*(by or []), "column_position").orderBy(F.desc("adjusted"), "document_type", "field_name")
    return out.withColumn("rank", F.row_number().over(order))


def column_scores(matches: DataFrame, columns: int | str, by: list[str] | None = None) -> DataFrame:
    """``document_type, column_score``: the mean of a type's first matches, as many as there are columns (or a column tells), by column and rank."""
    order = W.partitionBy(*(by or []), "document_type").orderBy("column_position", "rank")
    most = F.col(columns) if isinstance(columns, str) else F.lit(columns)
    return matches.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy(*(by or []), "document_type").agg(F.avg("adjusted").alias("column_score"))


def coverage(matches: DataFrame, fields: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``document_type, coverage``: the share of its required fields that some column matches well; 1 if none is required."""
    by = by or []
    covered = matches.groupBy(*by, "document_type", "field_name").agg(F.max("adjusted").alias("best"))
    need = fields.select("document_type", "field_name", F.col("required").cast("boolean").alias("required"))
    if by:  # a table's types are those that it has matches of
        need = matches.select(*by, "document_type").distinct().join(need, "document_type")
    both = need.join(covered, [*by, "document_type", "field_name"], "left")
    required = F.count_if(F.col("required"))
    met = F.count_if(F.col("required") & (F.coalesce("best", F.lit(0.0)) > COVERED))
    return both.groupBy(*by, "document_type").agg(F.when(required == 0, 1.0).otherwise(met / required).alias("coverage"))


def document_scores(neighbours: DataFrame, label: str = "document_type", by: list[str] | None = None) -> DataFrame:
    return neighbours.groupBy(*(by or []), label).agg(F.avg("similarity").alias("document_score"))


def hybrid(documents: DataFrame, columns: DataFrame, covered: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All document types with their three scores, weighted ``score`` and ``rank``; a missing score counts as 0."""
    key = [*(by or []), "document_type"]
    out = documents.join(columns, key, "full").join(covered, key, "left")
    parts = {name: F.coalesce(c, F.lit(0.0)) for name, c in (("document", "document_score"), ("column", "column_score"), ("coverage", "coverage"))}
    score = sum((WEIGHTS[name] * c for name, c in parts.items()), F.lit(0.0))
    out = out.select(*key, parts["document"].alias("document_score"), parts["column"].alias("column_score"), parts["coverage"].alias("coverage"), rounded(score, 4).alias("score"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*(by or [])).orderBy(F.desc("score"), "document_type")))


def suggest(matches: DataFrame, accept: float = ACCEPT, gap: float = GAP, by: list[str] | None = None) -> DataFrame:
    """``column_name, target_field, confidence, lead, status`` for each column.

    mapped: the best match is good enough and leads the next, or the next is the same field;
    ambiguous: good enough without that lead; unmapped: not good enough.
    """
    key = [*(by or []), "column_name"]
    order = W.partitionBy(*key).orderBy(F.desc("confidence"), "field_name")
    ranked = matches.select(*key, "field_name", F.col("confidence"), F.row_number().over(order).alias("n"), F.lead("confidence").over(order).alias("next"), F.lead("field_name").over(order).alias("next_field"))
    lead = F.col("confidence") - F.coalesce("next", F.lit(0.0))
    clear = F.col("next").isNull() | (rounded(lead, 9) >= gap) | (F.col("next_field") == F.col("field_name"))
    status = F.when(F.col("confidence") < accept, "unmapped").when(clear, "mapped").otherwise("ambiguous")
    out = ranked.where("n = 1").select(*key, F.col("field_name"), "confidence", rounded(lead, 6).alias("lead"), status.alias("status"))
    return out.select(*key, F.when(F.col("status") == "mapped", F.col("field_name")).alias("target_field"), "confidence", "lead", "status")


def conflicts(mapping: DataFrame) -> DataFrame:
    """``target_field, columns``: fields with more than one column, those by confidence, then name."""
    members = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "column_name"))), lambda x: x["column_name"])
    grouped = mapping.where("target_field is not null").groupBy("target_field").agg(members.alias("columns"))
    return grouped.where(F.size("columns") > 1)


def by_alias(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """``column_name, field_name``: the first field, in schema order, whose name or alias a column's name is.

    ``fields``: field_position, field_name, aliases.
    """
    names = fields.select("field_position", "field_name", F.explode(F.array_distinct(F.concat(F.array("field_name"), F.coalesce("aliases", F.array())))).alias("alias"))
    joined = columns.join(names, snake(F.col("column_name")) == snake(F.col("alias")))
    return joined.groupBy("column_name").agg(F.min_by("field_name", F.struct("field_position", "field_name")).alias("field_name"))


def sweep(scores: DataFrame, accepts: list[float], gaps: list[float]) -> DataFrame:
    """``accept, gap, below, ambiguous, above``: columns on either side of each pair of thresholds.

    ``scores``: confidence, lead.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("accept"), F.lit(g).alias("gap")) for a in accepts for g in gaps]))
    each = scores.select("confidence", "lead", grid.alias("t"))
    good = F.col("confidence") >= F.col("t.accept")
    clear = F.col("lead") >= F.col("t.gap")
    return each.groupBy("t.accept", "t.gap").agg(F.count_if(~good).alias("below"), F.count_if(good & ~clear).alias("ambiguous"), F.count_if(good & clear).alias("above"))


#: Bands of scores: least score and name (fixed values).
BANDS = [(0.90, ">=90%"), (0.85, "85-90%"), (0.82, "82-85%"), (0.80, "80-82%"), (0.75, "75-80%"), (0.70, "70-75%"), (0.60, "60-70%"), (0.50, "50-60%"), (float("-inf"), "<50%")]


def histogram(scores: DataFrame) -> DataFrame:
    """``band, count`` of ``confidence``; null scores have no band."""
    band = F.coalesce(*[F.when(F.col("confidence") >= low, F.lit(name)) for low, name in BANDS])
    return scores.where("confidence is not null").groupBy(band.alias("band")).agg(F.count("*").alias("count"))
