"""Many files ingested and classified in one plan each: what ``classify`` does for a table, keyed by file."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions.parsing import snake
from ..operators import matching, profiler
from ..sources.files import shared_folder
from .classify import indexed

BY = ["file"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, as several results are made of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Files:
    """Results for all files: their profiles, all types' scores, each column's suggestion, and what failed."""

    profiles: DataFrame
    scores: DataFrame
    suggestions: DataFrame
    errors: DataFrame

    @property
    def types(self) -> DataFrame:
        """``file, document_type, score`` of the best type of each file."""
        return self.scores.where("rank = 1").select(*BY, "document_type", "score")


def _ingestible(records: DataFrame, cells: DataFrame, files: DataFrame) -> DataFrame:
    """``records`` with ``error``: why a record cannot be ingested, or null."""
    there = cells.select("file", "column_name").distinct().groupBy("file").agg(F.collect_set("column_name").alias("names"))
    both = records.join(files.withColumnsRenamed({"error": "fault"}).select("file", "fault", F.lit(True).alias("read")), "file", "left").join(there, "file", "left")
    absent = F.array_sort(F.array_except(F.map_keys("column_mappings"), F.coalesce("names", F.array().cast("array<string>"))))
    error = F.coalesce(F.when(F.col("read").isNull(), "no such file, or an empty one"), "fault", F.when(F.col("names").isNull(), "no rows"), F.when(F.size(absent) > 0, F.concat(F.lit("not in the table: "), F.array_join(absent, ", "))))
    return both.withColumn("error", error).drop("read", "fault", "names")


def ingest(records: DataFrame, cells: DataFrame, files: DataFrame, embedder: embedding.Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled files as examples, their mappings as known ones, and ``item_id, file, error`` of all records.

    ``records``: file, item_id, vertical, document_type, column_mappings; ``cells`` and ``files`` as
    ``sources.many.read`` gives them.  Records that fail are told and left out.
    """
    records = _kept(_ingestible(records, cells, files), "records")
    good = records.where("error IS NULL")
    own = cells.join(good.select("file").distinct(), "file", "left_semi")
    text = profiler.table_text(profiler.described(profiler.profile_cells(own, BY)), BY)
    examples = embedding.with_vectors(text, "text", embedder).join(good, "file").select("item_id", "vertical", "document_type", "vector", "column_mappings")
    known = good.select("vertical", "document_type", F.explode("column_mappings").alias("source_column", "target_field"))
    return examples, known, records.select("item_id", "file", "error")


def _matches(columns: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The most similar fields of each file's columns; a field one of whose names a column has counts as 1."""
    key = F.to_json(F.array("file", F.col("column_position").cast("string")))
    asked = columns.select(key.alias("query_id"), "vector")
    near = matching.nearest(asked, index.withColumn("item_id", F.concat_ws("_", "vertical", "document_type", "field_name")), max(k, 5))
    facts = columns.select(*BY, "column_position", "column_name", "detected_type", key.alias("query_id"))
    wanted = [*BY, "column_position", "column_name", "detected_type", "document_type", "field_name", "field_type"]
    near = near.join(facts, "query_id").select(*wanted, "similarity")
    names = index.select("document_type", "field_name", "field_type", F.explode(F.array_distinct(F.concat(F.array("field_name"), F.coalesce("aliases", F.array())))).alias("name"))
    same = facts.withColumn("name", snake(F.col("column_name"))).join(names, "name").select(*wanted, F.lit(1.0).alias("similarity"))
    best = near.unionByName(same).groupBy(*wanted).agg(F.max("similarity").alias("similarity"))
    return matching.adjusted(best, BY)


def _inside(columns: DataFrame, index: DataFrame, winners: DataFrame) -> DataFrame:
    """Each column against all fields of its file's type."""
    both = columns.join(winners, BY).join(index.withColumnRenamed("vector", "field_vector"), "document_type")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("vector", "field_vector") / F.nullif(F.sqrt(dot("vector", "vector")) * F.sqrt(dot("field_vector", "field_vector")), F.lit(0.0))
    named = F.array_contains(F.array_distinct(F.concat(F.array("field_name"), F.coalesce("aliases", F.array()))), snake(F.col("column_name")))
    similarity = F.when(named, 1.0).otherwise(F.round(cosine, 6))
    rows = both.select(*BY, "column_position", "column_name", "detected_type", "document_type", "field_name", "field_type", similarity.alias("similarity"))
    return matching.adjusted(rows.where("similarity IS NOT NULL"), BY)


def classify(cells: DataFrame, files: DataFrame, fields: DataFrame, examples: DataFrame | None = None, embedder: embedding.Embedder | None = None, k: int = 5) -> Files:
    """Types, scores and suggestions of all files (``sources.many.read``), each as if it were alone.

    Files with an error, or without rows, have no scores; ``errors`` tells which.
    """
    profiles = _kept(profiler.profile_cells(cells, BY), "profiles")
    described = profiler.described(profiles)
    columns = _kept(embedding.with_vectors(described, "embedding_text", embedder), "columns")
    index = _kept(indexed(fields, embedder), "fields")
    matches = _kept(_matches(columns, index, k), "matches")
    width = columns.groupBy(*BY).agg(F.count("*").alias("width"))
    if examples is None:
        documents = cells.sparkSession.createDataFrame([], "file string, document_type string, document_score double")
    else:
        whole = embedding.with_vectors(profiler.table_text(described, BY), "text", embedder).select(F.col("file").alias("query_id"), "vector")
        documents = matching.document_scores(matching.nearest(whole, examples, k).withColumnRenamed("query_id", "file"), by=BY)
    scores = _kept(matching.hybrid(documents, matching.column_scores(matches.join(width, BY), "width", BY), matching.coverage(matches, fields, BY), BY), "scores")
    winners = scores.where("rank = 1").select(*BY, "document_type")
    suggestions = matching.suggest(_inside(columns, index, winners).select(*BY, "column_name", "field_name", F.col("adjusted").alias("confidence")), by=BY)
    errors = files.select("file", F.coalesce("error", F.when(F.col("rows") == 0, "no rows")).alias("error")).where("error IS NOT NULL")
    return Files(profiles, scores, suggestions, errors)
