"""Quality by nearest neighbours in a latent-semantic space.

A text becomes counts of hashed byte trigrams and of a few traits, damped, weighted by rarity and
scaled to unit length; the leading singular vectors of a labelled sample turn it into a short vector.
The sample's vectors, bounded in number, go to every task, which takes the exact cosines of each of
its texts with all of them, block by block, and lets the nearest vote with their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices
from .quality_rules import text_counts

#: Labelled texts of each label that the model keeps at most.
SAMPLE = 1500
#: Cells that trigrams are hashed to, length of a latent vector, and neighbours that vote.
CELLS, DIMENSIONS, NEIGHBOURS = 2048, 48, 31
#: A text is predicted to be good from this score.
THRESHOLD = 0.7
#: Traits count beside the trigrams with this weight.
TRAITS, TRAIT_WEIGHT = 5, 3.0
#: Texts whose products are taken together.
BLOCK = 256
#: Decimal digits of a cosine; what differs only beyond them is equal, whatever the block that it is computed in.
DIGITS = 6


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: damped trigram counts, scaled to unit length, and traits; zeros for an empty or null one."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(size)
    counts = np.zeros((n, CELLS), np.float32)
    end = np.cumsum(size)
    for i, (e, k) in enumerate(zip(end.tolist(), size.tolist())):
        if k >= 3:
            raw = np.frombuffer(texts[i].as_buffer(), np.uint8).astype(np.uint32)
            code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
            counts[i] = np.bincount(code >> np.uint32(32 - CELLS.bit_length() + 1), minlength=CELLS)
    np.sqrt(counts, out=counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    c = {k: v.astype(float) for k, v in text_counts(texts).items()}
    traits = np.stack([
        np.minimum(1, c["n_symbols"] / np.maximum(c["n_words"], 1) / 0.3),
        np.minimum(1, c["n_repeat_words"] / np.maximum(c["n_words"], 1) / 0.5),
        np.minimum(1, c["n_echoes"] / np.maximum(c["n_words"], 1) / 0.3),
        np.minimum(1, c["n_upper"] / np.maximum(c["word_chars"], 1) / 0.5),
        np.minimum(1, np.maximum(0, 10 - c["n_words"]) / 10),
    ], axis=1)
    return np.concatenate([counts, traits.astype(np.float32)], axis=1)


@dataclass
class Model:
    """rarity: weight of each feature; axes: features to latent vector; vectors, good, weight: the sample."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    weight: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.rarity) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of good among the nearest, by similarity; the share in all labels where nothing is similar."""
        out = np.empty(len(x))
        for i in range(0, len(x), BLOCK):
            near = self.latent(x[i : i + BLOCK]).astype(float) @ self.vectors.T.astype(float)
            near = np.round(near, DIGITS)
            k = min(NEIGHBOURS, near.shape[1])
            if not k:
                out[i : i + BLOCK] = self.prior
                continue
            at = nearest(near, k)
            vote = np.maximum(np.take_along_axis(near, at, 1), 0) ** 4 * self.weight[at]
            total = vote.sum(1)
            out[i : i + BLOCK] = np.where(total > 0, (vote * self.good[at]).sum(1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's ``k`` largest, in ascending order; of equals at the end those that come first."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    above, equal = near > least, near == least
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(chosen)[1].reshape(len(near), k)


def _featured(docs: DataFrame, carry: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                x = features(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in carry] + [pa.array([r.tobytes() for r in x], pa.binary())], [*carry, "x"])

    return docs.select(*carry, "text").mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + [T.StructField("x", T.BinaryType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` texts of each label of ``labels.quality``, those whose hashed ids come first.

    Held-out rows, null ids, ids that ``docs`` has not and labels other than 0 and 1 take no part, in
    the sample or in the shares of the labels.  Several labels of one id count as its largest, of
    several texts of one id the smallest is learnt from.  Only the sample's features reach the driver.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    by_label = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    chosen = [known.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in (0, 1)]
    # At most 2 * sample rows of two numbers, whatever the size of the corpus.
    few = F.broadcast(chosen[0].union(chosen[1]))
    rows = _featured(docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")), ["doc_id", "good"]).orderBy("doc_id").collect()
    n = CELLS + TRAITS
    if not rows:
        return Model(np.ones(n, np.float32), np.zeros((n, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    good = np.array([r["good"] for r in rows], float)
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2
    rarity[CELLS:] = TRAIT_WEIGHT
    weighed = x * rarity
    _, vectors = np.linalg.eigh((weighed.T @ weighed).astype(np.float64))
    axes = vectors[:, ::-1][:, : min(DIMENSIONS, len(x))].astype(np.float32)
    here = {g: max(1, int((good == g).sum())) for g in (0, 1)}
    weight = np.array([by_label.get(int(g), 1) / here[int(g)] for g in good])
    model = Model(rarity.astype(np.float32), axes, np.zeros((0, 1)), good, weight / weight.max(), by_label.get(1, 0) / max(1, sum(by_label.values())))
    model.vectors = model.latent(x)
    return model


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``score``, ``predicted`` of its ``text``, which come last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                score = np.concatenate([shared.value.score(features(piece.column("text").slice(i, 1024))) for i in range(0, piece.num_rows, 1024)])
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in carry] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*carry, "score", "predicted"])

    out = T.StructType([docs.schema[c] for c in carry] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; empty and null texts have a score too."""
    return scored(docs, fit(docs, labels), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their columns."""
    model = fit(docs, labels)
    clash = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.withColumnsRenamed(clash)
    return scored(renamed, model, renamed.columns).where("predicted = 1").select(*renamed.columns).withColumnsRenamed({v: k for k, v in clash.items()})
