"""Near duplicates by SimHash: binary tries of fingerprints joined with themselves.

Two fingerprints with at most ``most`` differing bits have at most half of these in one half of their bits.
So there are two tries: one reads the high half first and allows ``most // 2`` differences in it, the other
reads the low half first and allows what is left, ``most - most // 2 - 1``; both allow ``most`` in all.
A trie is cut into leaves of a bounded number of fingerprints, deeper where fingerprints are dense.
Every fingerprint walks down the trie together with the leaves and is sent to the meetings of its own leaf
with the leaves whose beginnings stay within the budget.  In a meeting two small tries are traversed
together: pairs of nodes go down bit by bit, gather differing bits and end when there are too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, small, split_words
from .components import components

SEED = 42
#: Fingerprints of a leaf at most: LEAF, or one in 2**LEAVES_BITS of all, so that no trie has more than 2**LEAVES_BITS nodes of a depth that are cut.
LEAF, LEAVES_BITS = 1 << 13, 14
#: Shingles whose bits are counted at once.
HASHED = 1 << 17
#: Bits by which leaves are sought deeper at a time.
STEP = 8
#: Pairs of fingerprints that two nodes may give to be looked at one by one, and pairs of nodes that go down together.
FEW, FRONTIER = 32, 1 << 18


def fingerprints(texts: pa.Array, words: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if it is in over half of the hashes of its shingles.

    Shingles count as often as they occur.  A text of fewer words has its whole sequence as one shingle;
    a text without words, or null, has fingerprint zero.
    """
    flat, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    line = b" ".join(flat.cast(pa.binary()).to_pylist())
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(size) else size
    n = np.diff(offsets)
    shingles = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    whose, total, often = np.repeat(np.arange(len(n)), shingles), int(shingles.sum()), np.zeros((len(n), 64), np.int64)
    first = np.repeat(offsets[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(total)
    last = first + np.minimum(n, words)[whose] - 1
    hashed, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, total, HASHED):
        part = slice(at, at + HASHED)
        each = (hashed(line[a:e], seed) for a, e in zip(begin[first[part]].tolist(), (begin[last[part]] + size[last[part]]).tolist()))
        bits = np.unpackbits(np.fromiter(each, "<u8", len(first[part])).view(np.uint8), bitorder="little").reshape(-1, 64)
        of = whose[part]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        often[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    out = np.packbits(2 * often > shingles[:, None], axis=1, bitorder="little").view("<u8")[:, 0] if len(n) else np.zeros(0, np.uint64)
    return out


def _print(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                marks = pa.array(fingerprints(piece.column("text"), words).view(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), marks], ["doc_id", "mark"])

    return run


class Trie:
    """Sorted different keys, or beginnings of keys with their depths, none of which begins another.

    A node of depth ``d`` is the run of keys that share their first ``d`` bits.
    """

    def __init__(self, keys: np.ndarray, depths: np.ndarray | None = None):
        self.keys, self.depths = keys, np.full(len(keys), 64) if depths is None else depths
        self._firsts: dict[int, np.ndarray] = {}
        self._levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def firsts(self, depth: int) -> np.ndarray:
        """Where the nodes of a depth begin, and the number of keys."""
        if depth not in self._firsts:
            top = self.keys >> np.uint64(64 - depth) if depth else np.zeros(len(self.keys), np.uint64)
            new = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else []
            self._firsts[depth] = np.append(new, len(top)).astype(np.int32)
        return self._firsts[depth]

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each node's children by the next bit (-1: none), and whether the node is a key that ends here."""
        if depth not in self._levels:
            here, below = self.firsts(depth), self.firsts(depth + 1)
            child = np.searchsorted(below[:-1], here[:-1]).astype(np.int32)
            one = (self.keys[here[:-1]] >> np.uint64(63 - depth) & np.uint64(1)).astype(bool)
            two = below[child + 1] < here[1:]
            ends = self.depths[here[:-1]] <= depth
            self._levels[depth] = (np.where(one, -1, child), np.where(one | ends, child, np.where(two, child + 1, -1)), ends)
        return self._levels[depth]


def meet(a: Trie, b: Trie, most: int, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(i, j)`` of keys with at most ``most`` differing bits and ``lead`` among the first 32.

    ``a`` has whole keys; where ``b`` has beginnings, only their bits count.  If both are the same
    trie, each pair comes once, the smaller place first.
    """
    if not len(a.keys) or not len(b.keys):
        return
    same, root = a is b, np.zeros(1, np.int32)
    stack = [(0, root, root, np.zeros(1, np.int8))]
    while stack:
        depth, x, y, far = stack.pop()
        if len(x) > FRONTIER:
            half = len(x) // 2
            stack += [(depth, x[:half], y[:half], far[:half]), (depth, x[half:], y[half:], far[half:])]
            continue
        xs, ys = a.firsts(depth), b.firsts(depth)
        nx, ny = (s[n + 1].astype(np.int64) - s[n] for s, n in ((xs, x), (ys, y)))
        few = nx * ny <= FEW if depth < 64 else np.ones(len(x), bool)
        if few.any():
            many = nx[few] * ny[few]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = np.repeat(ny[few], many)
            i, j = np.repeat(xs[x[few]], many) + at // wide, np.repeat(ys[y[few]], many) + at % wide
            if same:
                i, j = i[i < j], j[i < j]
            differ = (a.keys[i] ^ b.keys[j]) >> np.uint64(64) - b.depths[j].astype(np.uint64) << np.uint64(64) - b.depths[j].astype(np.uint64)
            near = (np.bitwise_count(differ) <= most) & (np.bitwise_count(differ >> np.uint64(32)) <= lead)
            if near.any():
                yield i[near], j[near]
            x, y, far = x[~few], y[~few], far[~few]
        if not len(x):
            continue
        (x0, x1, _), (y0, y1, ends) = a.level(depth), b.level(depth)
        limit, went = lead if depth < 32 else most, []
        for s, left in enumerate((x0[x], x1[x])):
            for t, right in enumerate((y0[y], y1[y])):
                go = (left >= 0) & (right >= 0) & (far + (s ^ t) <= limit)
                go &= ~ends[y] if s != t else True  # all bits after a beginning's own fit it
                if same:
                    go &= left <= right
                went.append((left[go], right[go], far[go] + np.int8(s ^ t)))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*went))))


def _joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of ``n`` places is connected to."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _turned(keys: np.ndarray, trie: int) -> np.ndarray:
    """The keys of a trie from fingerprints, and the other way round."""
    return keys << np.uint64(32) | keys >> np.uint64(32) if trie else keys


def _budgets(most: int) -> tuple[int, int]:
    """Differing bits that each trie allows in its first 32."""
    return most // 2, most - most // 2 - 1


def _leaves(keys: DataFrame, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both tries the beginnings and depths of nodes with at most ``leaf`` keys whose parents have more.

    Only counts come to the driver, those of nodes under the ones that are still too large; as ``leaf``
    grows with the keys, at most 2 * 2**(LEAVES_BITS + STEP) of them.
    """
    spark, found, open_, depth = keys.sparkSession, ([], []), [(0, 0), (1, 0)], 0
    while open_:
        prefix = lambda d: F.shiftrightunsigned("key", 64 - d) if d else F.lit(0).cast("long")
        large = F.broadcast(spark.createDataFrame(open_, "trie int, inside long"))
        under = keys.withColumn("inside", prefix(depth)).join(large, ["trie", "inside"], "left_semi")
        counts = under.groupBy("trie", prefix(depth + STEP).alias("node")).agg(F.count("*").alias("n")).collect()
        open_ = []
        for trie in (0, 1):
            level = {r["node"] % (1 << depth + STEP): r["n"] for r in counts if r["trie"] == trie}
            sums = [level]
            for _ in range(STEP):
                above: dict[int, int] = {}
                for node, n in sums[-1].items():
                    above[node >> 1] = above.get(node >> 1, 0) + n
                sums.append(above)
            for up, nodes in enumerate(sums):
                for node, n in nodes.items():
                    if n <= leaf and (up == STEP and depth == 0 or up < STEP and sums[up + 1][node >> 1] > leaf):
                        found[trie].append((node << 64 - depth - STEP + up, depth + STEP - up))
            open_ += [(trie, node) for node, n in level.items() if n > leaf]
        depth += STEP
    out = []
    for nodes in found:
        nodes.sort()
        out.append((np.array([n for n, _ in nodes], np.uint64), np.array([d for _, d in nodes], np.int64)))
    return out


def _into_leaves(leaves: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy().view(np.uint64)
            for trie, (starts, _) in enumerate(leaves):
                keys = _turned(marks, trie)
                of = np.searchsorted(starts, keys, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), trie, np.int32)), pa.array(of.astype(np.int32)), pa.array(keys.view(np.int64))], ["trie", "leaf", "key"])

    return run


def _sent(leaves: list[tuple[np.ndarray, np.ndarray]], most: int):
    """From all keys of a leaf what is sent to its meetings: with itself, and those that come near another leaf to that one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        trie, own = (k.as_py() for k in key)
        keys = np.sort(rows.column("key").to_numpy().view(np.uint64))
        beginnings = Trie(*leaves[trie])
        near = [x for x in meet(Trie(keys), beginnings, most, _budgets(most)[trie])]
        which, to = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*near) if near else ((), ())))
        order = np.lexsort((which, to))
        which, to = which[order], to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() if len(to) else []
        out = [(min(own, leaf), max(own, leaf), int(leaf < own), keys[which[s:e]].tobytes()) for s, e in zip(cut, cut[1:] + [len(to)]) for leaf in [int(to[s])]]
        one, two, side, packed = zip(*out)
        return pa.table({"trie": pa.array([trie] * len(out), pa.int32()), "one": pa.array(one, pa.int32()), "two": pa.array(two, pa.int32()), "side": pa.array(side, pa.int32()), "keys": pa.array(packed, pa.binary())})

    return run


def _met(most: int):
    """From the keys of a meeting links of each linked one to the first that it is connected with here."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        trie, one, two = (k.as_py() for k in key)
        sides = [np.sort(np.frombuffer(b"".join(r for s, r in zip(rows.column("side").to_pylist(), rows.column("keys").to_pylist()) if s == side), np.uint64)) for side in (0, 1)]
        left = Trie(sides[0])
        right = left if one == two else Trie(sides[1])
        shift = 0 if one == two else len(sides[0])
        keys = _turned(np.concatenate(sides), trie).view(np.int64)
        label = _joined(len(keys), ((i, j + shift) for i, j in meet(left, right, most, _budgets(most)[trie])))
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(keys[label[tied]]), "b": pa.array(keys[tied])})

    return run


def links(marks: DataFrame, most: int = 4) -> DataFrame:
    """``(a, b)``: links that connect what differs by at most ``most`` bits, of different fingerprints ``mark``.

    All fingerprints that are connected through such pairs are so through these links; inside a meeting
    a fingerprint is tied to the first one that it is connected with, whether near or not.
    """
    spark = marks.sparkSession
    turned = F.shiftleft("mark", 32).bitwiseOR(F.shiftrightunsigned("mark", 32))
    keys = marks.select(F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("mark").alias("key")), F.struct(F.lit(1).alias("trie"), turned.alias("key")))).alias("k")).select("k.*")
    n = marks.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    leaves = _leaves(keys, max(LEAF, n >> LEAVES_BITS))
    dealt = marks.mapInArrow(_into_leaves(leaves), "trie int, leaf int, key long")
    sent = dealt.groupBy("trie", "leaf").applyInArrow(_sent(leaves, most), "trie int, one int, two int, side int, keys binary")
    return sent.groupBy("trie", "one", "two").applyInArrow(_met(most), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 4, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (``doc_id, text``).

    ``fingerprint`` has 16 hexadecimal digits; fingerprints link at ``most`` differing bits or fewer.
    ``component_id`` is the smallest ``doc_id`` that links reach, null only if none of them has an id.
    Texts without words and null ones have fingerprint zero and link like any others.  Rows with one
    ``doc_id`` are rows of their own.
    """
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_print(words), "doc_id long, mark long"), "prints")
    marks = materialise(rows.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "marks")
    found = materialise(links(marks.select("mark"), most), "found")
    labels = components(found)
    members = materialise(marks.join(labels, F.col("mark") == F.col("node")).select("mark", "least", "label"), "members")
    least = materialise(members.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    # Whoever shares its fingerprint or is linked has a component to look up; the others are their own.
    linked = members.join(small(least), "label").select("mark", "component_id")
    alike = marks.where("copies > 1").join(members, "mark", "left_anti").select("mark", F.col("least").alias("component_id"))
    named = materialise(linked.unionByName(alike), "named")
    discard(found, labels, marks, members, least)
    own = rows.join(small(named), "mark", "left")
    return own.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
