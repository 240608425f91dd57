"""Labelled tables that are kept: an append for each change, of each id the newest entry counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

TABLE = "ground_truth"
#: What an entry has; what a labelled table lacks is null.
COLUMNS = {
    "item_id": "string", "vertical": "string", "document_type": "string", "labeler": "string", "source": "string", "row_count": "long", "column_count": "int",
    "column_mappings": "map<string,string>", "vector": "array<double>", "labelled_at": "timestamp",
}


class GroundTruth:
    """Entries in a catalog's table.  Nothing is rewritten: a later entry of an id, or its removal, hides earlier ones."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def _append(self, rows: DataFrame, removed: bool) -> int:
        columns = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items() if c != "labelled_at"]
        at = F.coalesce(F.col("labelled_at").cast("timestamp"), F.current_timestamp()) if "labelled_at" in rows.columns else F.current_timestamp()
        entries = rows.select(*columns, at.alias("labelled_at"), F.lit(removed).alias("removed"))
        return self.catalog.put(TABLE, entries.where("item_id is not null").withColumn("stamp", F.expr("uuid()")), append=True)

    def add(self, rows: DataFrame) -> int:
        """Appends entries (``item_id`` and any of COLUMNS); without a time they are of now.  Returns the catalog's version."""
        return self._append(rows, False)

    def remove(self, ids: DataFrame) -> int:
        """Appends the removal of each ``item_id``."""
        return self._append(ids, True)

    def entries(self) -> DataFrame | None:
        """All entries that were ever made."""
        entry = self.catalog.entries().get(TABLE)
        return self.catalog.frame(entry) if entry else None

    def current(self) -> DataFrame:
        """The newest entry of each id that is not removed; of entries of one time any one.

        Only ids, times and stamps are aggregated; the vectors are joined to what was found.
        """
        rows = self.entries()
        if rows is None:
            return self.catalog.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
        last = rows.groupBy("item_id").agg(F.max(F.struct("labelled_at", "removed", "stamp")).alias("last")).where("not last.removed")
        return rows.join(last.select("item_id", F.col("last.stamp").alias("stamp")), ["item_id", "stamp"]).select(*COLUMNS)

    def newest(self, limit: int | None = None, where: Column | None = None) -> DataFrame:
        """The listing, newest first, without vectors and mappings; ties by id."""
        rows = self.current() if where is None else self.current().where(where)
        out = rows.select(*[c for c in COLUMNS if c not in ("vector", "column_mappings")]).orderBy(F.desc("labelled_at"), "item_id")
        return out if limit is None else out.limit(limit)

    def counts(self) -> DataFrame:
        return self.current().groupBy("vertical", "document_type").agg(F.count("*").alias("tables"), F.max("labelled_at").alias("last"))
