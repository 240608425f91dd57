"""From an unknown table to a document type, a mapping of its columns, and the conversions that it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, embedding, units
from ..operators import matching, profiler
from ..sources import schemas


@dataclass
class Classification:
    """Scores of all types, the best one, and for each column a suggestion with its conversion."""

    document_type: str | None
    scores: DataFrame
    suggestions: DataFrame
    conflicts: DataFrame
    conversions: dict[str, tuple[str, str]]

    @property
    def mappings(self) -> dict[str, str]:
        return {r["column_name"]: r["target_field"] for r in self.suggestions.where("target_field is not null").collect()}


#: The format of dates that schemas ask for.
ISO = "YYYY-MM-DD"


def _held(df: DataFrame) -> DataFrame:
    """A result of a few rows for each column or type of a table, computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def indexed(fields: DataFrame, embedder: embedding.Embedder | None = None) -> DataFrame:
    """Schema fields with the vector of their names."""
    text = F.concat_ws(" ", F.regexp_replace("field_name", "_", " "), F.regexp_replace("field_name", "_", " "), F.array_join("aliases", " "))
    return embedding.with_vectors(fields.withColumn("text", text), "text", embedder)


def column_matches(profiles: DataFrame, index: DataFrame, embedder: embedding.Embedder | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most similar fields of each column; a field one of whose names the column has counts as 1."""
    columns = embedding.with_vectors(profiler.described(profiles), "embedding_text", embedder)
    near = matching.nearest(columns.select(F.col("column_position").alias("query_id"), "vector"), index.withColumn("item_id", F.concat_ws("_", "vertical", "document_type", "field_name")), max(k, 5))
    known = profiles.select("column_position", "column_name", "detected_type")
    names = F.array_distinct(F.concat(F.array("field_name"), F.coalesce("aliases", F.array())))
    from ..functions.parsing import snake

    same = known.crossJoin(matching.bounded(index.drop("vector", "text").withColumn("names", names))).where(F.array_contains("names", snake(F.col("column_name"))))
    same = same.select("column_position", "column_name", "detected_type", "document_type", "field_name", "field_type", F.lit(1.0).alias("similarity"))
    near = near.withColumnRenamed("query_id", "column_position").join(known, "column_position").select(*same.columns)
    best = near.unionByName(same).groupBy(*[c for c in same.columns if c != "similarity"]).agg(F.max("similarity").alias("similarity"))
    return matching.adjusted(best)


def classify(table: DataFrame, examples: DataFrame | None = None, fields: DataFrame | None = None, embedder: embedding.Embedder | None = None, order: Column | None = None, k: int = 5) -> Classification:
    """Hybrid classification of a table.

    ``examples``: labelled tables as ``item_id, document_type, vector``; without them the score rests
    on columns and coverage.  Ties go to the type that comes first by name.  Suggestions rest on a second
    search, among the fields of the best type alone.
    """
    spark = table.sparkSession
    fields = schemas.fields(spark) if fields is None else fields
    data = table.drop("_row") if "_row" in table.columns else table
    profiles = profiler.profile(data if order is not None else table, order if order is not None else (F.col("_row") if "_row" in table.columns else None), data.columns)
    profiles = profiles.cache()
    index = indexed(fields, embedder)
    matches = column_matches(profiles, index, embedder, k).cache()
    if examples is None:
        documents = spark.createDataFrame([], "document_type string, document_score double")
    else:
        whole = embedding.with_vectors(profiler.table_text(profiler.described(profiles)), "text", embedder)
        documents = matching.document_scores(matching.nearest(whole.select(F.lit(0).alias("query_id"), "vector"), examples, k))
    scores = matching.hybrid(documents, matching.column_scores(matches, len(data.columns)), matching.coverage(matches, fields))
    first = scores.orderBy("rank").limit(1).collect()
    winner = first[0]["document_type"] if first else None
    inside = column_matches(profiles, index.where(F.col("document_type") == F.lit(winner)), embedder, k).select("column_name", "field_name", F.col("adjusted").alias("confidence"))
    suggestions = _held(matching.suggest(inside))
    wanted = {r["field_name"]: r["unit"] for r in fields.where((F.col("document_type") == winner) & F.col("unit").isNotNull()).collect()}
    # A suggestion's conversion: one row for each column of the table, so few.
    conversions = {}
    mapped = suggestions.where("target_field is not null").join(profiles.select("column_name", "sample_values"), "column_name").collect()
    for r in mapped:
        unit = wanted.get(r["target_field"])
        if unit in units.ALIASES:
            accepted = [unit, *(a for a, b in units.CONVERSIONS if b == unit)]
            found = units.conversion(r["column_name"], unit, accepted, units.unit_of_name(r["column_name"], accepted) or units.unit_of_samples(r["sample_values"], unit, accepted))
            if found["needed"]:
                conversions[r["target_field"]] = (found["source"], unit)
    days = {r["column_name"]: r["target_field"] for r in mapped if wanted.get(r["target_field"]) == ISO}
    for r in dates.column_formats(data, list(days)).where(F.col("date_format") != ISO).collect() if days else []:
        conversions[days[r["column_name"]]] = (r["date_format"], ISO)
    conflicts, scores = _held(matching.conflicts(suggestions)), _held(scores)
    for kept in (profiles, matches):
        kept.unpersist()
    return Classification(winner, scores, suggestions, conflicts, conversions)


def classify_by_examples(table: DataFrame, examples: DataFrame, known: DataFrame | None = None, embedder: embedding.Embedder | None = None, order: Column | None = None, vertical: str | None = None, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """A table's type by the vote of its ``k`` most similar examples, and a suggestion for each column.

    ``examples``: item_id, document_type, vector, column_mappings (as ``ingest`` gives them); ``known``: known
    mappings (``knowledge.upsert``).  Gives ``document_type, confidence``, and ``vertical`` by a vote of its own if examples have one, without a row if no example is
    similar, and ``matching.column_suggestions``: what those examples mapped a column to, or the most similar known column's target if that is surer.
    """
    data = table.drop("_row") if "_row" in table.columns else table
    order = F.col("_row") if order is None and "_row" in table.columns else order
    described = profiler.described(profiler.profile(table, order, data.columns)).cache()
    whole = embedding.with_vectors(profiler.table_text(described), "text", embedder).select(F.lit(0).alias("query_id"), "vector")
    near = matching.nearest(whole, examples, k).cache()
    names = described.select(F.col("column_name").alias("source_column"))
    similar = table.sparkSession.createDataFrame([], "source_column string, target_field string, similarity double, rank int, matched_column string")
    if known is not None:
        asked = embedding.with_vectors(described, "embedding_text", embedder).select(F.col("column_name").alias("query_id"), "vector")
        indexed_ = embedding.with_vectors(known.withColumn("text", F.concat_ws(" ", F.regexp_replace("source_column", "_", " "), F.regexp_replace("target_field", "_", " "))), "text", embedder).drop("text")
        similar = matching.similar_columns(asked, indexed_, 3, vertical).select(F.col("query_id").alias("source_column"), "target_field", "similarity", "rank", F.col("source_column").alias("matched_column"))
    voted = matching.vote(near, "document_type")
    if "vertical" in examples.columns:
        voted = voted.join(matching.vote(near.where("vertical IS NOT NULL"), "vertical").select("query_id", "vertical"), "query_id", "left")
    return voted.drop("query_id"), matching.column_suggestions(names, matching.mapping_vote(near), similar)


def ingest_all(tables: list[tuple[DataFrame, str, str, dict[str, str]]], embedder: embedding.Embedder | None = None, vertical: str = "medical") -> tuple[DataFrame | None, DataFrame | None, list[tuple[str, str | None]]]:
    """Ingests labelled tables ``(table, item_id, document_type, mappings)`` one by one: all examples, all mappings, and each table's error or None.

    A table that fails is left out and does not stop the others.
    """
    examples, known, told = None, None, []
    for table, item_id, document_type, mappings in tables:
        try:
            missing = sorted(set(mappings) - set(table.columns))
            if missing:
                raise ValueError(f"not in the table: {', '.join(missing)}")
            example, new = ingest(table, item_id, document_type, mappings, embedder, vertical)
        except Exception as e:
            told.append((item_id, f"{type(e).__name__}: {e}"))
            continue
        examples = example if examples is None else examples.unionByName(example)
        known = new if known is None else known.unionByName(new)
        told.append((item_id, None))
    return examples, known, told


def ingest(table: DataFrame, item_id: str, document_type: str, mappings: dict[str, str], embedder: embedding.Embedder | None = None, vertical: str = "medical") -> tuple[DataFrame, DataFrame]:
    """A labelled table as an example (``item_id, vertical, document_type, vector, column_mappings``) and its mappings for the known ones."""
    spark = table.sparkSession
    text = profiler.table_text(profiler.described(profiler.profile(table)))
    maps = F.create_map(*[F.lit(x) for kv in mappings.items() for x in kv]) if mappings else F.create_map().cast("map<string,string>")
    example = embedding.with_vectors(text, "text", embedder).select(F.lit(item_id).alias("item_id"), F.lit(vertical).alias("vertical"), F.lit(document_type).alias("document_type"), "vector", maps.alias("column_mappings"))
    known = spark.createDataFrame([(vertical, document_type, s, t) for s, t in mappings.items()], "vertical string, document_type string, source_column string, target_field string")
    return example, known
