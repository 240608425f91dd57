"""Vectors of texts.  An embedder is anything with ``embed(df, column)``; the one here needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Column) -> Column: ...


#: N-grams whose places a task remembers, and characters of texts that it looks at together.
REMEMBERED, TOGETHER = 1 << 20, 1 << 20


class HashedNgrams:
    """Counts of hashed character n-grams of a text in lower case, signed, with unit length.  A null or empty text gives zeros."""

    def __init__(self, dimensions: int = 256, low: int = 2, high: int = 4):
        self.dimensions, self.low, self.high = dimensions, low, high

    def vectors(self, texts: list[str], known: dict[str, int] | None = None) -> np.ndarray:
        """A row for each text.  ``known`` keeps each n-gram's place, negative minus one for those that count down."""
        known = {} if known is None else known
        grams: list[str] = []
        counts = []
        for text in texts:
            t, before = f" {text.lower()} " if text else "", len(grams)
            for n in range(self.low, self.high + 1):
                grams += [t[i : i + n] for i in range(len(t) - n + 1)]
            counts.append(len(grams) - before)
        for gram in set(grams) - known.keys():
            h = xxhash.xxh3_64_intdigest(gram)
            known[gram] = h % self.dimensions if h >> 63 else -1 - h % self.dimensions
        at = np.fromiter(map(known.__getitem__, grams), np.int64, len(grams))
        place = np.repeat(np.arange(len(texts)) * self.dimensions, counts) + np.where(at < 0, -1 - at, at)
        out = np.bincount(place, np.where(at < 0, -1.0, 1.0), len(texts) * self.dimensions).reshape(len(texts), self.dimensions)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0).astype(np.float32)

    def embed(self, texts: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, int] = {}
            for batch in batches:
                rows, held, out = [], 0, []
                for text in batch.fillna(""):
                    rows.append(text)
                    held += len(text)
                    if held > TOGETHER:
                        out += list(self.vectors(rows, known))
                        rows, held = [], 0
                    if len(known) > REMEMBERED:
                        known.clear()
                yield pd.Series(out + list(self.vectors(rows, known)), dtype=object)

        return run(texts)


class ModelBatches:
    """Vectors of a model that takes lists of texts: batches of ``size``, whatever the batches that Spark sends.

    ``load`` is called once in a task and gives the model, a function from texts to as many vectors.  A text
    is prefixed by ``prefix``, what such models ask for queries and for passages, and cut to ``longest``
    characters; null and blank texts give null and do not reach the model.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], size: int = 64, prefix: str = "", longest: int | None = None):
        self.load, self.size, self.prefix, self.longest = load, size, prefix, longest

    def for_queries(self) -> ModelBatches:
        return ModelBatches(self.load, self.size, "query: ", self.longest)

    def for_passages(self) -> ModelBatches:
        return ModelBatches(self.load, self.size, "passage: ", self.longest)

    def embed(self, texts: Column) -> Column:
        load, size, prefix, longest = self.load, self.size, self.prefix, self.longest

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, rows, waiting = load(), [], 0

            def vectors() -> pd.Series:
                asked = [f"{prefix}{t[:longest]}" for t in rows if t]
                found = iter(np.asarray(model(asked), np.float32) if asked else [])
                return pd.Series([next(found) if t else None for t in rows], dtype=object)

            # Spark takes the rows of all batches in order, however they are cut, so a batch of the model may span several.
            for batch in batches:
                for text in batch:
                    text = text.strip() if isinstance(text, str) else ""
                    rows.append(text)
                    waiting += bool(text)
                    if waiting == size:
                        yield vectors()
                        rows, waiting = [], 0
            if rows:
                yield vectors()

        return run(texts)


def with_vectors(df: DataFrame, text: str, embedder: Embedder | None = None, name: str = "vector") -> DataFrame:
    return df.withColumn(name, (embedder or HashedNgrams()).embed(F.col(text)))
