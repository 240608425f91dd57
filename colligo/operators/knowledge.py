"""Tables that grow by what has been learnt: known mappings, indexed ids, labelled examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["vertical", "document_type", "source_column", "target_field"]


def upsert(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """Known mappings with the new ones taken up: ``occurrence_count`` grows by one for each row of ``new``."""
    counted = new.groupBy(*KEY).agg(F.count("*").alias("occurrence_count"))
    if known is None:
        return counted
    return known.select(*KEY, "occurrence_count").unionByName(counted).groupBy(*KEY).agg(F.sum("occurrence_count").alias("occurrence_count"))


def not_indexed(items: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The items whose key the index does not have."""
    return items.join(index.select(key).distinct(), key, "left_anti")
