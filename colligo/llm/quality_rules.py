"""Quality rules: plain counts for each text, and robust multivariate outliers.

For every language and source a minimum-covariance-determinant estimate is made over all of its
texts: from two starts, medians with quartiles and plain moments, each step keeps the three quarters of
the rows with the smallest Mahalanobis distances and takes their mean and covariance anew; of both ends
the one with the smaller determinant counts.  A step is one aggregation over
(group, distance bin) that adds up whole numbers, so its result depends neither on the order of the
rows nor on how a large group is spread, and no group is ever in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import discard, materialise, mix, row_of, slices, split_words

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_echoes"]
#: The transformed statistics are whole multiples of 1/SCALE.
SCALE = 256
#: The share of a group's rows that the estimate rests on.
SHARE = 0.75
#: The least standard deviation that counts, for each transformed statistic: word length, symbols,
#: repeated lines, repeated words and capitals, each as in vector().
FLOORS = (0.12, 0.25, 0.25, 0.25, 0.25)
#: A text is an outlier beyond this Mahalanobis distance.
CUTOFF = 6.0
#: The rows that the wider estimate (a language's, or that of all rows) counts for in a group's own.
LEAST_GROUP = 200
STEPS = 4


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts STATS of each text; a null or empty text has zeros."""
    texts = pc.fill_null(texts, "")
    words, offsets = split_words(texts)
    row, n = row_of(offsets), len(texts)

    def per_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n).astype(np.int64) if len(values) else np.zeros(n, np.int64)

    out = {"n_words": np.diff(offsets), "word_chars": per_text(pc.utf8_length(words).to_numpy(zero_copy_only=False), row)}
    out["n_symbols"] = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    out["n_upper"] = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    of_line = row_of(lines.offsets.to_numpy() - lines.offsets.to_numpy()[0])
    wordy = pc.match_substring_regex(flat, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    code = flat.dictionary_encode().indices.to_numpy()[wordy].astype(np.int64)
    of_line = of_line[wordy]
    different = np.unique(of_line.astype(np.int64) * (len(flat) + 1) + code) // (len(flat) + 1)
    out["n_lines"] = np.bincount(of_line, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(different, minlength=n)
    code = words.dictionary_encode().indices.to_numpy()
    out["n_echoes"] = np.bincount(row[1:][(code[1:] == code[:-1]) & (row[1:] == row[:-1])], minlength=n)
    out["n_repeat_words"] = _repeated(code, row, n)
    return out


def _repeated(words: np.ndarray, row: np.ndarray, n: int, window: int = 5) -> np.ndarray:
    """Words inside a window of five that occurs twice or more in its text."""
    k = len(words) - window + 1
    if k <= 0:
        return np.zeros(n, np.int64)
    code = mix(words.astype(np.uint64) + np.uint64(1))
    key = mix(row[:k].astype(np.uint64) + np.uint64(1 << 40))
    for i in range(window):
        key = mix(key + code[i : i + k])
    inside = row[:k] == row[window - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


def counted(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the counts of its ``text``, which come last."""
    needed = list(dict.fromkeys([*carry, "text"]))
    out = T.StructType([docs.schema[c] for c in carry] + [T.StructField(s, T.LongType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = text_counts(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in carry] + [pa.array(found[s], pa.int64()) for s in STATS], [*carry, *STATS])

    return docs.select(*needed).mapInArrow(run, out)


def vector() -> list[Column]:
    """The transformed statistics as whole numbers; few words pull each towards an ordinary text's."""
    words = F.col("n_words").cast("double")
    share = lambda count, per: F.log(1 + 20 * F.col(count) / (per + 20))
    real = [
        F.log((F.col("word_chars") + 100) / (words + 20)),
        F.log(1 + 20 * F.col("n_symbols") / (words + 20)),
        share("n_dup_lines", F.col("n_lines")),
        F.log(1 + 20 * F.col("n_repeat_words") / (words + 20)),
        F.log(1 + 20 * F.col("n_upper") / (F.col("word_chars") + 100)),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"z{i}") for i, x in enumerate(real)]


def _distance() -> Column:
    """Squared Mahalanobis distance of z0.. from ``centre`` with the inverse covariance ``inverse``."""
    p = len(FLOORS)
    gap = [F.col(f"z{i}") / SCALE - F.col("centre")[i] for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        total = total + gap[i] * gap[i] * F.col("inverse")[i * p + i]
        for j in range(i):
            total = total + 2 * gap[i] * gap[j] * F.col("inverse")[i * p + j]
    return total


def _chi2(p: int, x: float) -> float:
    """P(chi-square with p degrees of freedom <= x)."""
    term = math.exp(-x / 2 + (p / 2) * math.log(x / 2) - math.lgamma(p / 2 + 1))
    total, k = term, p / 2
    while term > 1e-16 * total:
        k += 1
        term *= x / 2 / k
        total += term
    return total


def _consistency(p: int) -> float:
    """What makes the kept share's covariance that of a whole normal sample."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(p, mid) < SHARE else (low, mid)
    return SHARE / _chi2(p + 2, low)


_PARAMS = "level int, lang string, source string, rows long, centre array<double>, inverse array<double>"
_TRIED = f"start int, {_PARAMS}, volume double"


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    p, factor = len(FLOORS), _consistency(len(FLOORS))
    for pdf in batches:
        centre, inverse, volume = [], [], []
        for r in pdf.itertuples():
            mean = np.array([getattr(r, f"s{i}") for i in range(p)], float) / r.kept / SCALE
            cov = np.empty((p, p))
            for i in range(p):
                for j in range(i + 1):
                    cov[i, j] = cov[j, i] = getattr(r, f"s{j}_{i}") / r.kept / SCALE**2 - mean[i] * mean[j]
            centre.append(mean)
            cov = cov * factor + np.diag(np.square(FLOORS))
            inverse.append(np.linalg.inv(cov).ravel())
            volume.append(np.linalg.slogdet(cov)[1])
        yield pdf[["start", "level", "lang", "source", "rows"]].assign(centre=centre, inverse=inverse, volume=volume)


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def fit(counts: DataFrame) -> DataFrame:
    """The estimates of every language and source, of every language, and of all texts.

    ``counts`` has ``lang``, ``source`` and STATS.  A null language or source is one with the empty
    one.  Texts of fewer than ten words take no part.
    """
    p = len(FLOORS)
    z = [f"z{i}" for i in range(p)]
    rows = counts.where("n_words >= 10").select(_key("lang").alias("lang"), _key("source").alias("source"), *vector())
    # Equal vectors of a group count as one row with a weight.
    rows = materialise(rows.groupBy("lang", "source", *z).agg(F.count("*").alias("w")), "vectors")
    by_source = rows.withColumn("level", F.lit(0))
    by_lang = rows.groupBy("lang", *z).agg(F.sum("w").alias("w")).withColumns({"source": F.lit(""), "level": F.lit(1)})
    overall = rows.groupBy(*z).agg(F.sum("w").alias("w")).withColumns({"lang": F.lit(""), "source": F.lit(""), "level": F.lit(2)})
    rows = materialise(by_source.unionByName(by_lang).unionByName(overall), "levels")
    first = rows.groupBy("level", "lang", "source").agg(
        F.sum("w").alias("rows"), *[F.percentile(c, [0.25, 0.5, 0.75], F.col("w")).alias(f"q{i}") for i, c in enumerate(z)]
    )
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * SCALE), F.lit(FLOORS[i])) for i in range(p)]
    sums = [F.sum(F.col("w") * F.col(f"z{i}")).alias(f"s{i}") for i in range(p)]
    sums += [F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{j}_{i}") for i in range(p) for j in range(i + 1)]
    quartiles = first.select(
        F.lit(0).alias("start"), "level", "lang", "source", "rows", F.array(*[F.col(f"q{i}")[1] / SCALE for i in range(p)]).alias("centre"),
        F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inverse"), F.lit(0.0).alias("volume"),
    )
    moments = rows.groupBy("level", "lang", "source").agg(F.sum("w").alias("kept"), F.sum("w").alias("rows"), *sums).withColumn("start", F.lit(1)).mapInPandas(_estimates, _TRIED)
    params = materialise(quartiles.unionByName(moments), "params")
    group = ["start", "level", "lang", "source"]
    for _ in range(STEPS):
        far = rows.join(params, ["level", "lang", "source"]).withColumn("bin", F.floor(8 * F.log2(_distance() + 1e-4)).cast("int"))
        bins = far.groupBy(*group, "bin").agg(F.sum("w").alias("kept"), F.max("rows").alias("rows"), *sums)
        before = F.sum("kept").over(W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        near = bins.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SHARE * F.col("rows"))
        total = near.groupBy(*group).agg(F.max("rows").alias("rows"), *[F.sum(c).alias(c) for c in bins.columns if c not in (*group, "bin", "rows")])
        last, params = params, materialise(total.mapInPandas(_estimates, _TRIED), "params")
        discard(last)
    best = params.groupBy("level", "lang", "source").agg(F.min(F.struct("volume", "start", "rows", "centre", "inverse")).alias("x"))
    out = materialise(best.select("level", "lang", "source", *[F.col(f"x.{c}").alias(c) for c in ("rows", "centre", "inverse")]), "params")
    discard(rows, params)
    return out


def _blends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    p = len(FLOORS)
    for pdf in batches:
        centre, inverse = [], []
        for r in pdf.itertuples():
            at, cov = np.zeros(p), np.zeros((p, p))
            for k, (rows, c, i) in enumerate(zip(r.chain_rows, r.chain_centre, r.chain_inverse)):
                share = rows / (rows + LEAST_GROUP) if k else 1.0
                at = share * np.asarray(c) + (1 - share) * at
                cov = share * np.linalg.inv(np.reshape(i, (p, p))) + (1 - share) * cov
            centre.append(at)
            inverse.append(np.linalg.inv(cov).ravel())
        yield pdf[["level", "lang", "source", "rows"]].assign(centre=centre, inverse=inverse)


def blended(params: DataFrame) -> DataFrame:
    """``params`` with each language's estimate blended with that of all texts, and each source's with its language's so blended.

    An estimate's share is its rows in its rows and LEAST_GROUP, so no number of rows switches from one to another.
    """
    at = lambda level, *names: params.where(f"level = {level}").select(*names, F.col("rows").alias(f"n{level}"), F.col("centre").alias(f"c{level}"), F.col("inverse").alias(f"i{level}"))
    whole = at(2)
    wide = at(1, "lang").join(F.broadcast(whole), F.lit(True))
    own = at(0, "lang", "source").join(wide, "lang")
    chain = lambda df, level, lang, source: df.select(
        F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"), F.col(f"n{level}").alias("rows"),
        *[F.array(*[f"{c}{k}" for k in range(2, level - 1, -1)]).alias(name) for c, name in (("n", "chain_rows"), ("c", "chain_centre"), ("i", "chain_inverse"))],
    )
    none = F.lit("")
    every = chain(whole, 2, none, none).unionByName(chain(wide, 1, F.col("lang"), none)).unionByName(chain(own, 0, F.col("lang"), F.col("source")))
    return every.mapInPandas(_blends, _PARAMS)


def judged(counts: DataFrame, params: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed``, ``distance`` (null only where no text at all has ten words) and ``kept``."""
    params = materialise(blended(params), "blended")
    own = params.where("level = 0").select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("centre").alias("_c0"), F.col("inverse").alias("_i0"))
    wide = params.where("level = 1").select(F.col("lang").alias("_w"), F.col("centre").alias("_c1"), F.col("inverse").alias("_i1"))
    whole = params.where("level = 2").select(F.col("centre").alias("_c2"), F.col("inverse").alias("_i2"))
    names = counts.columns
    df = counts.join(own, (_key("lang") == F.col("_l")) & (_key("source") == F.col("_s")), "left").join(wide, _key("lang") == F.col("_w"), "left").join(F.broadcast(whole), F.lit(True), "left")
    df = df.select(*names, *vector(), F.coalesce("_c0", "_c1", "_c2").alias("centre"), F.coalesce("_i0", "_i1", "_i2").alias("inverse"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.select(*names, failed.alias("base_failed"), F.sqrt(_distance()).alias("distance"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept`` for each row of ``docs``; null and empty texts fail."""
    counts = materialise(counted(docs, ["doc_id", "lang", "source"]), "counts")
    return judged(counts, fit(counts)).drop("lang", "source")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    counts = materialise(counted(docs, ["lang", "source"]), "counts")
    clash = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang", "source")}
    renamed = docs.withColumnsRenamed(clash)
    return judged(counted(renamed, renamed.columns), fit(counts)).where("kept").select(*renamed.columns).withColumnsRenamed({v: k for k, v in clash.items()})
