"""Words of longer texts, across the rows of a table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import bounded

#: What Spark's regular expressions take for white space.
_SPACES = re.compile("[ \\t\\n\\x0b\\f\\r]+")


def _first_spellings(key: str):
    """Each text's words, the first of those that are alike in lower case, in one string; no row for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tokens = [], []
            for i, (text, low) in enumerate(zip(batch.column("text").to_pylist(), batch.column("low").to_pylist())):
                words, lows = (_SPACES.split(x) if x else [] for x in (text, low))
                first = dict(zip(reversed(lows), reversed(words)))
                if found := " ".join(first[x] for x in dict.fromkeys(lows) if x):
                    at.append(i)
                    tokens.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(tokens, pa.string())], [key, "tokens"])

    return run


def distinct_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, tokens``: a text's different words, the first spelling of each, in order, whatever their case.

    A text is read where it lies, in time that grows with its words.  Only texts that share a key, if
    there are any, which is counted, have their words grouped across tasks.  Texts without words have no row.
    """
    texts = df.select(key, F.col(text).alias("text"), F.lower(text).alias("low"))
    shared = df.groupBy(F.col(key).alias("_shared")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, tokens string"
    if shared.isEmpty():
        return texts.mapInArrow(_first_spellings(key), schema)
    shared = bounded(shared)
    same = F.col(key).eqNullSafe(F.col("_shared"))
    alone = texts.join(shared, same, "left_anti").mapInArrow(_first_spellings(key), schema)
    words = df.join(shared, same, "left_semi").select(key, F.posexplode(F.split(text, r"\s+")).alias("at", "word")).where("word <> ''")
    first = words.groupBy(key, F.lower("word").alias("low")).agg(F.min(F.struct("at", "word")).alias("first"))
    ordered = first.groupBy(key).agg(F.array_sort(F.collect_list("first")).alias("all"))
    return alone.unionByName(ordered.select(key, F.array_join(F.transform("all", lambda x: x["word"]), " ").alias("tokens")))
