"""Hard negatives against a plain search, and the bounds that they rest on."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from colligo.llm import hard_negatives, vectors
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int"


def whole(v):
    return [int(Fraction(x) * 256 // 1) for x in v]


def product(a, b):
    return max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def plain(rows, is_anchor, positives=5, negatives=3):
    rows = [(i, whole(v), label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    anchors, out = {(i, tuple(v), label) for i, v, label in rows if is_anchor(i)}, []
    for i, v, label in anchors:
        scored = sorted((-product(v, w), j, other) for j, w, other in rows if j != i)
        best = [(-s, j) for s, j, other in scored if other == label][:positives]
        for p, j in sorted(set(best)):
            fit = [(-s, n) for s, n, other in scored if other != label and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, rank + 1, n, p, s) for rank, (s, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], VECTORS)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect()))


def test_bounds_hold_on_every_level():
    rng = np.random.default_rng(1)
    for width in (0, 1, 3, 4, 17, 64, 130):
        a, b = (np.floor(256 * rng.normal(size=(40, width))).astype(np.int64) for _ in range(2))
        exact = a @ b.T
        of_a, of_b = (hard_negatives.levels(*hard_negatives.summaries(x)) for x in (a, b))
        widths = []
        for (ma, da), (mb, db) in zip(of_a, of_b):
            assert (np.abs(exact - ma @ mb.T) <= da @ db.T + 1e-5 * (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1) + 1)).all()
            widths.append((da @ db.T).sum())
        assert all(x >= y * 0.999 for x, y in zip(widths, widths[1:]))  # shorter segments bound more closely


def test_against_plain_search(spark, monkeypatch):
    """Ties, repeated rows, few labels of which one has most rows, nulls, vectors of other lengths and too large ones."""
    monkeypatch.setattr(hard_negatives, "RANGE", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rng = random.Random(4)
    near = [rng.gauss(0, 0.3) for _ in range(24)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in near], 0 if rng.random() < 0.5 else rng.randrange(4)) for i in range(120)]
    rows += [(200 + i, [round(rng.uniform(-1, 1), 1) for _ in range(6)], i % 3) for i in range(30)]
    rows += [(300 + i, near, i % 3) for i in range(12)] + rows[:6] + [(5, near, 2), (5, near, 2), (7, near[:3], 1)]
    rows += [(None, near, 1), (400, None, 1), (405, near, None), (410, [1.0, None], 1), (415, [1.0, float("nan")], 1), (420, [float("inf")], 1), (425, [], 1), (426, [], 2)]
    rows += [(430, [1e300, 2.0], 1), (431, [-1e300, 1.0], 2), (435, [1e17, 1e17], 1), (436, [3e8] * 30, 0), (440, [3e7] * 24, 2), (441, [2e7] * 24, 2), (442, [1.9e7] * 24, 3)]
    got, want = mined(spark, rows), plain(rows, lambda i: i % 5 == 0)
    assert got == want and len(want) > 200
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 2)]) == []


def test_long_vectors_do_not_widen_others(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(8)], i % 2) for i in range(600)] + [(1000, [rng.gauss(0.3, 1) for _ in range(20_000)], 1)]
    cut = vectors._cuts([8] * 600 + [20_000], [0] * 601, 4096)
    assert cut == [0, 600] and mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("positive", [0, 1, 19, 20, 101, -7, 2**63 - 1])
def test_windows(positive):
    low, high = hard_negatives.windows(np.array([positive, vectors.NONE]), 50, 95)
    assert low[0] == -(-50 * positive // 100) and high[0] == 95 * positive // 100 and low[1] > high[1]
