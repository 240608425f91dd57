"""A stored index of schema fields with their vectors, which knows what it has by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding
from ..sources.catalog import Catalog

KEY = ["vertical", "document_type", "field_name"]


class FieldIndex:
    """Vectors of fields in generations.  A generation grows by what is new or changed; a forced one replaces it in one step."""

    def __init__(self, catalog: Catalog, embedder: embedding.Embedder | None = None, name: str = "field_index"):
        self.catalog, self.embedder, self.name = catalog, embedder, name

    def _hashed(self, fields: DataFrame) -> DataFrame:
        """Fields with the hash of all that they are, whatever the order of their columns; repeated ones once."""
        columns = [F.col(c) for c in sorted(fields.columns)]
        return fields.withColumn("content", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)).dropDuplicates([*KEY, "content"])

    def index(self, fields: DataFrame, force: bool = False) -> int:
        """Takes up fields (KEY, ``text`` and more); returns how many rows were written.

        Rows that are there with the same content are not embedded again.  ``force`` embeds all of
        ``fields`` and drops everything else at once: readers see the old generation or the new one.
        """
        fresh = self._hashed(fields)
        entry = self.catalog.entries().get(self.name)
        if entry is not None and not force:
            there = self.current().select(*KEY, "content")
            same = [fresh[c].eqNullSafe(there[c]) for c in (*KEY, "content")]
            fresh = fresh.join(there, same, "left_anti")
        # A field's version is that of the catalog it was written after, so later content counts.
        after = max(self.catalog.versions(), default=0)
        rows = embedding.with_vectors(fresh.withColumn("generation", F.lit(after).cast("long")), "text", self.embedder)
        part = self.catalog.write(self.name, rows)
        written = self.catalog.spark.read.parquet(part["path"]).count()
        if written or force or entry is None:
            self.catalog.change(lambda old: old | {self.name: {"parts": [*([] if force or self.name not in old else old[self.name]["parts"]), part], "facts": {}}})
        else:
            self.catalog.files.delete(part["path"])
        return written

    def current(self) -> DataFrame | None:
        """The newest content of each field with its vector; None if nothing was ever indexed."""
        entry = self.catalog.entries().get(self.name)
        if entry is None:
            return None
        rows = self.catalog.frame(entry)
        if len(entry["parts"]) == 1:
            return rows.drop("generation")
        last = rows.groupBy(*KEY).agg(F.max(F.struct("generation", "content")).alias("last")).select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("last.content").alias("_content"))
        found = rows.join(last, [*[rows[c].eqNullSafe(last[f"_{c}"]) for c in KEY], rows["content"] == last["_content"]])
        return found.select(*rows.columns).dropDuplicates([*KEY, "content"]).drop("generation")

    def remove(self, document_type: str) -> None:
        """A new generation without a document type."""
        rows = self.current()
        if rows is not None:
            kept = rows.where(~F.col("document_type").eqNullSafe(F.lit(document_type))).withColumn("generation", F.lit(max(self.catalog.versions())).cast("long"))
            self.catalog.put(self.name, kept)
