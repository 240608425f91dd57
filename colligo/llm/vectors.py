"""Blocks of vectors as whole numbers, for searches by inner product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of a block at most, so that one long vector makes no block large (it may be longer than that alone).
CELLS = 1 << 22
#: Products of norms below this have exact sums in double precision; those below _LARGEST fit 64 bits.
_EXACT, _LARGEST = float(1 << 52), float(1 << 62)
#: The largest score that is told; _NONE stands for a score that is not known.
MOST = (1 << 63) - 1
NONE = -(1 << 63)
#: Coordinates of the shortest segment that has a summary.
SEGMENT = 4


def sound(embedding: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def strongest(embedding: Column) -> Column:
    """The number of a vector's largest component, negative if that component is; 0 for an empty one."""
    size = F.transform(embedding, lambda x: F.abs(x.cast("double")))
    at = F.coalesce(F.array_position(size, F.array_max(size)), F.lit(0)).cast("int")
    return F.when(at == 0, 0).when(F.try_element_at(embedding, at) < 0, -at).otherwise(at)


@dataclass
class Block:
    """Some vectors: ids, whole numbers (zero in rows of ``huge``), norms, extra numbers of each row, and vectors too large for 64 bits."""

    ids: np.ndarray
    numbers: np.ndarray
    norms: np.ndarray
    extra: np.ndarray
    huge: dict[int, list[int]]

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, rows: slice | np.ndarray) -> Block:
        huge = {}
        if self.huge:
            huge = {k: self.huge[r] for k, r in enumerate(np.arange(len(self))[rows].tolist()) if r in self.huge}
        return Block(self.ids[rows], self.numbers[rows], self.norms[rows], self.extra[rows], huge)

    def vector(self, row: int) -> list[int]:
        return self.huge[row] if row in self.huge else self.numbers[row].tolist()

    def sizes(self) -> np.ndarray:
        """The vectors as floats, those too large cut so that their products are no less than infinite or right."""
        out = self.numbers.astype(float)
        for row, whole in self.huge.items():
            out[row] = [float(max(-(10**300), min(10**300, x))) for x in whole]
        return out


#: A block as a row.
PACKED = "ids binary, width int, kind string, numbers binary, extra binary, huge binary"


def _cuts(widths: list[int], groups: list, size: int) -> list[int]:
    """Where blocks begin: each of at most ``size`` rows and CELLS numbers, of one group."""
    out, widest, group = [], 0, None
    for i, (w, g) in enumerate(zip(widths, groups)):
        if not out or i - out[-1] >= size or g != group or (i - out[-1] + 1) * max(widest, w) > CELLS:
            out.append(i)
            widest, group = 0, g
        widest = max(widest, w)
    return out


def packing(size: int, scale: int, extras: int = 0, group: str | None = None):
    """Packs rows ``(vec_id, embedding, extra numbers ...)`` as they come, each component x as floor(scale * x).

    With ``group``, a column of small numbers, every block has rows of one group, which it is told with.
    """

    def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column("embedding")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        width, flat = int(n.max(initial=0)), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        there = np.arange(width) < n[:, None]
        vectors = np.zeros((len(rows), width))
        with np.errstate(over="ignore"):
            vectors[there] = np.floor(scale * flat)
        huge = np.flatnonzero((np.abs(vectors) >= _LARGEST).any(1)) if width else np.zeros(0, np.int64)
        raw = np.zeros((len(rows), width))
        raw[there] = flat
        vectors[huge] = 0
        most = np.abs(vectors).max(initial=0)
        kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", _LARGEST * 2)) if most < top)
        extra = np.stack([pc.fill_null(rows.column(2 + k).cast(pa.int64()), NONE).to_numpy() for k in range(extras)], 1) if extras else np.zeros((len(rows), 0), np.int64)
        packed = huge.astype(np.int64).tobytes() + raw[huge].tobytes()
        out = [rows.column("vec_id").to_numpy().astype(np.int64).tobytes(), width, kind, vectors.astype(kind).tobytes(), extra.tobytes(), packed]
        kinds, names = [pa.binary(), pa.int32(), pa.string(), *[pa.binary()] * 3], ["ids", "width", "kind", "numbers", "extra", "huge"]
        arrays = [pa.array([x], t) for x, t in zip(out, kinds)]
        return pa.RecordBatch.from_arrays(arrays + ([rows.column(group).slice(0, 1).cast(pa.int64())] if group else []), names + ([group] if group else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            widths = pc.list_value_length(rows.column("embedding")).to_pylist()
            cuts = _cuts(widths, rows.column(group).to_pylist() if group else widths and [0] * len(widths), size)
            for s, e in zip(cuts, cuts[1:]):
                yield pack(rows.slice(s, e - s))
            held = rows.slice(cuts[-1]) if cuts else None
        if held is not None and held.num_rows:
            yield pack(held)

    return run


def unpacked(ids: bytes, width: int, kind: str, numbers: bytes, extra: bytes, huge: bytes, scale: int) -> Block:
    n = len(ids) // 8
    vectors = np.frombuffer(numbers, kind).reshape(n, width).astype(np.int64)
    large = len(huge) // (8 * (width + 1))
    raw = np.frombuffer(huge, np.float64, -1, 8 * large).reshape(large, width)
    whole = {row: [int(Fraction(x) * scale // 1) for x in values] for row, values in zip(np.frombuffer(huge, np.int64, large).tolist(), raw.tolist())}
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    return Block(np.frombuffer(ids, np.int64), vectors, norms, np.frombuffer(extra, np.int64).reshape(n, -1) if extra else np.zeros((n, 0), np.int64), whole)


def _exact(x: list[int], y: list[int]) -> int:
    return max(NONE + 1, min(MOST, sum(a * b for a, b in zip(x, y))))


def scores(q: Block, c: Block) -> np.ndarray:
    """Exact whole-number inner products, the shorter vector as one with zeros behind it; those beyond 64 bits as the last number that fits."""
    width = min(q.numbers.shape[1], c.numbers.shape[1])
    a, b = q.numbers[:, :width], c.numbers[:, :width]
    most = q.norms.max(initial=0) * c.norms.max(initial=0)
    if most < _EXACT:
        out = np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    else:
        out = a @ b.T
        for i, j in zip(*np.nonzero(np.outer(q.norms, c.norms) >= _LARGEST)):
            out[i, j] = _exact(q.vector(i), c.vector(j))
    for i in q.huge:
        out[i] = [_exact(q.vector(i), c.vector(j)) for j in range(len(c))]
    for j in c.huge:
        out[:, j] = [_exact(q.vector(i), c.vector(j)) for i in range(len(q))]
    return out


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``a`` and ``j`` of ``b``, a bounded number of coordinates at a time."""
    out, step = np.zeros(len(i), a.dtype), max(1, CELLS // max(a.shape[1], 1))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        np.einsum("pk,pk->p", a[i[part]], b[j[part]], out=out[part])
    return out


def pair_scores(q: Block, c: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for pairs of rows."""
    width = min(q.numbers.shape[1], c.numbers.shape[1])
    out = pair_products(q.numbers[:, :width], c.numbers[:, :width], i, j)
    large = q.norms[i] * c.norms[j] >= _LARGEST
    for rows, index in ((q.huge, i), (c.huge, j)):
        if rows:
            large |= np.isin(index, list(rows))
    for p in np.flatnonzero(large).tolist():
        out[p] = _exact(q.vector(int(i[p])), c.vector(int(j[p])))
    return out
