"""Exact Jaccard join of texts on word shingles, by universe partition and pigeonhole.

A text's set holds 64-bit hashes of its distinct shingles.  Two sets of n and k shingles with a
similarity of at least t differ in at most h = (1-t)/(1+t) (n+k) of them.  The universe of hashes
is cut into segments, more of them for larger size bands; a text shows one signature for what it
has in each segment.  If a text shows h+1 segments that are not empty, a partner agrees with it on
one of them at least.  How many segments a band has is chosen by cost: fewer segments are larger
and collide less, but leave more texts short of h+1.  Those few texts also show the one-deletion
neighbourhoods of their segments, where a segment counts twice, since one difference is allowed in it.

Texts with one signature are candidates.  Small groups give all their pairs.  A group that is large
among the texts of one task is told there and only its head is sent on, so that no task gets all
members of a common signature.  Of a large group every member is first held against a head, then
against the best linked member of its largest component.  Where that leaves a group in several
components, texts with too few signatures outside such groups are compared with all members, block
by block, through parity sketches, whose distance never exceeds the true one.  Groups around the same
component are compared together, so that near copies meet once.  Nothing is missed, and no pairs are
formed that the sketches rule out.  What is left is verified on the whole texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise, mix, slices, small, split_words
from .components import components

#: Odd multipliers, one for each place in a shingle (fixed values).
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: A band's largest size is so many times its smallest.
_BAND = 1.5
#: Largest group of texts with one signature that gives all its pairs.
SMALL_GROUP = 12
#: Texts of a large group that others are compared with at once.
BLOCK = 1024
#: Signatures that a task gathers before it sends them on, which bounds its memory.
GATHERED = 1 << 20


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of ``words`` words, ASCII letters lower-cased.

    A text of fewer words has its whole sequence as one shingle; a text without words, or null, an
    empty set.
    """
    flat, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = flat.dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = of_word[coded.indices.to_numpy()]
    places = np.resize(_PLACE, words) * np.repeat(np.arange(1, words // len(_PLACE) + 2, dtype=np.uint64) * np.uint64(2) - np.uint64(1), len(_PLACE))[:words]
    n = len(w) - words + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for i in range(words if n > 0 else 0):
        grams += w[i : i + n] * places[i]
    grams = mix(grams)
    out = []
    for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if e - a >= words:
            own = np.sort(grams[a : e - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif e > a:
            out.append(mix(np.array([(w[a:e] * places[: e - a]).sum(dtype=np.uint64) + np.uint64(e - a)], np.uint64)))
        else:
            out.append(grams[:0])
    return out


def most_different(n: int, k: int, percent: int) -> int:
    """The largest symmetric difference of sets of n and k with that similarity."""
    return (n + k) * (100 - percent) // (100 + percent)


@cache
def band_starts() -> np.ndarray:
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, int(at[-1] * _BAND)))
    return np.array(at)


@cache
def segments(band: int, percent: int) -> int:
    """The number of segments of a band: the cheapest of several.

    Costs are those of the band's largest sets: signatures shown, a collision for each segment of
    two hashes or fewer, and the one-deletion neighbourhoods of texts that come out short.
    """
    n = int(band_starts()[band + 1]) - 1
    need = most_different(n, n, percent) + 1 + slack(n, percent)
    best = (math.inf, 1)
    for many in np.linspace(1, 2.5, 31):
        m = max(1, math.ceil(need * many))
        full = m * (1 - math.exp(-n / m))
        spread = math.sqrt(max(m * math.exp(-n / m) * (1 - math.exp(-n / m)), 1e-9))
        short = 0.5 * math.erfc((full - need) / spread / math.sqrt(2))
        thin = math.exp(-n / m) * (n / m + (n / m) ** 2 / 2)
        best = min(best, (need * (1 + 4 * thin) + short * 3 * (n + m), m))
    return best[1]


def slack(n: int, percent: int) -> int:
    """Signatures shown beyond what the pigeonhole needs: so many may be too common to be of use."""
    return 0 if n < 4 else 2 + most_different(n, n, percent) // 10


def _hashed(contents: np.ndarray, segment: np.ndarray, band: int, kind: int) -> np.ndarray:
    return mix(contents + segment.astype(np.uint64) * _PLACE[0] + np.uint64((2 * band + kind) * int(_PLACE[1]) & (1 << 64) - 1))


def signatures(own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's signatures, and how many of them it can do without (negative: too few by so many)."""
    n, out, spare = len(own), [], 1 << 30
    if n == 0:
        return own, spare
    starts = band_starts()
    band = int(np.searchsorted(starts, n, "right")) - 1
    largest = n * 100 // percent
    mixed = mix(own)
    for b in range(band, int(np.searchsorted(starts, largest, "right"))):
        m = segments(b, percent)
        need = most_different(n, min(largest, int(starts[b + 1]) - 1), percent) + 1
        segment = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        contents = np.add.reduceat(mixed, first)
        shown = min(len(first), need + slack(n, percent))
        out.append(_hashed(contents[:shown], segment[first[:shown]], b, 0))
        spare = min(spare, shown - need)
        if shown < need:  # short: a segment of two hashes or more counts twice, with its neighbourhood
            size = np.diff(np.append(first, n))
            each = np.repeat(np.arange(len(first)), size)
            twice = size[each] >= 2
            out += [_hashed(contents, segment[first], b, 1), _hashed((contents[each] - mixed)[twice], segment[twice], b, 1)]
            if np.minimum(size, 2).sum() < need:
                out.append(_hashed(np.zeros(1, np.uint64), np.zeros(1, np.uint64), b, 1))
    return np.concatenate(out), spare


def sketch(own: np.ndarray, wide: int = 0) -> bytes:
    """Parities of the set's counts in 2**k cells, with as many cells as shingles or up to twice that.

    ``wide`` doubles the cells so many times.  A sketch folds to half its cells by exclusive or.
    Sketches never differ in more cells than their sets do in shingles.
    """
    cells = 1 << max(6, (max(len(own), 1) - 1).bit_length() + wide)
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, k = 8 * len(a), 8 * len(b)
    if n < k:
        x, y, n, k = y, x, k, n
    while n > k:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ y).bit_count()


#: What the tasks that make the signatures and those that group them tell.  doc: a text (a: its
#: class, which is its set; b: the text's hash).  class: a set.  pair: two classes that may be
#: similar.  common: a class in a large group (b: the group).
_TOLD = "kind string, doc_id long, n long, a long, b long, spare long, sketch binary"
_TYPES = {"doc_id": pa.int64(), "n": pa.int64(), "a": pa.int64(), "b": pa.int64(), "spare": pa.int64(), "sketch": pa.binary()}
#: A message to the task that groups part ``part``: rows to tell, or signatures, who shows them, and which stand for a large group.
_SENT = "part int, told binary, sigs binary, nodes binary, large binary"


def _rows(kind: str, count: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * count, pa.string())] + [columns[k] if k in columns else pa.nulls(count, t) for k, t in _TYPES.items()], ["kind", *_TYPES])


def _class_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _low(sigs: np.ndarray) -> bytes:
    """The six low bytes of each signature; the part that it is sent to is the rest."""
    return sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _group_names(low: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (low & np.uint64((1 << 48) - 1)) | (part.astype(np.uint64) << np.uint64(48))


def _members(nodes: np.ndarray) -> bytes:
    """Classes, as numbers in a list of the different ones if that is shorter."""
    few, at = np.unique(nodes, return_inverse=True)
    at = at.astype(np.min_scalar_type(max(len(few) - 1, 0)))
    if few.nbytes + at.nbytes < nodes.nbytes:
        return np.array([len(few), at.itemsize], np.int64).tobytes() + few.tobytes() + at.tobytes()
    return np.array([0, 0], np.int64).tobytes() + nodes.tobytes()


def _members_of(raw: bytes) -> np.ndarray:
    few, width = np.frombuffer(raw, np.int64, 2).tolist()
    if not few:
        return np.frombuffer(raw, np.int64, -1, 16)
    return np.frombuffer(raw, np.int64, few, 16)[np.frombuffer(raw, f"<u{width}", -1, 16 + 8 * few)]


def _starred(first: np.ndarray, large: np.ndarray, size: np.ndarray, names: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is told of large groups: their members, and each of them with the group's head."""
    which, head = np.repeat(large, size), np.repeat(nodes[first], size)
    yield _rows("common", int(which.sum()), a=pa.array(nodes[which]), b=pa.array(names[which].view(np.int64)))
    star = which & (head != nodes)
    yield from _pairs(head[star], nodes[star])


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        yield _rows("pair", len(part), a=pa.array(part[:, 0]), b=pa.array(part[:, 1]))


def _posted(sigs: list[np.ndarray], classes: list[int], parts: int) -> Iterator[pa.RecordBatch]:
    """The messages of some classes' signatures, one for each part.

    A group that is large among these classes alone is told here; only its head is sent on, so no
    task ever gets all members of a common signature.
    """
    sig, who = np.concatenate(sigs), np.repeat(np.array(classes, np.int64), [len(s) for s in sigs])
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    large = size > SMALL_GROUP
    standing = np.repeat(large, size)
    if large.any():
        yield from (_message(int(part[0]), told=[x]) for x in _starred(first, large, size, _group_names(sig, part), who))
        sent = ~standing
        sent[first] = True
        sig, who, part, standing = sig[sent], who[sent], part[sent], standing[sent]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    for s, e in zip(cut, cut[1:] + [len(sig)]):
        yield _message(int(part[s]), _low(sig[s:e]), _members(who[s:e]), np.packbits(standing[s:e]).tobytes() if standing[s:e].any() else b"")


def _message(part: int, sigs: bytes | None = None, nodes: bytes | None = None, large: bytes | None = None, told: list[pa.RecordBatch] | None = None) -> pa.RecordBatch:
    raw = None
    if told:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, told[0].schema) as out:
            for x in told:
                out.write_batch(x)
        raw = sink.getvalue().to_pybytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (raw, sigs, nodes, large))], ["part", "told", "sigs", "nodes", "large"])


def _signal(percent: int, words: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        sigs: list[np.ndarray] = []
        classes: list[int] = []
        held = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), words)
                nodes, new = [_class_of(s) for s in sets], {"a": [], "n": [], "spare": [], "sketch": []}
                for node, own in zip(nodes, sets):
                    if node not in met and len(own):
                        met.add(node)
                        mine, spare = signatures(own, percent)
                        sigs.append(mine)
                        classes.append(node)
                        held += len(mine)
                        for c, x in zip(new, (node, len(own), spare, sketch(own))):
                            new[c].append(x)
                docs = _rows("doc", len(sets), doc_id=piece.column("doc_id").cast(pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()), a=pa.array(nodes, pa.int64()), b=piece.column("hash"))
                told = _rows("class", len(new["a"]), **{c: pa.array(x, _TYPES[c]) for c, x in new.items()})
                yield _message(abs(nodes[0]) % parts, told=[docs, told])
                if held >= GATHERED:
                    yield from _posted(sigs, classes, parts)
                    met, sigs, classes, held = set(), [], [], 0
        if sigs:
            yield from _posted(sigs, classes, parts)

    return run


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, whose, standing = [], [], []
    for batch in batches:
        for part, told, sigs, nodes, large in zip(*(batch.column(c).to_pylist() for c in ("part", "told", "sigs", "nodes", "large"))):
            if told is not None:
                yield from pa.ipc.open_stream(told)
            if sigs:
                n = len(sigs) // 6
                low = np.zeros((n, 8), np.uint8)
                low[:, :6] = np.frombuffer(sigs, np.uint8).reshape(-1, 6)
                names.append(_group_names(low.view("<u8")[:, 0], np.full(n, part)))
                whose.append(_members_of(nodes))
                standing.append(np.unpackbits(np.frombuffer(large, np.uint8))[:n].astype(bool) if large else np.zeros(n, bool))
    if not names:
        return
    name, node, stands = np.concatenate(names), np.concatenate(whose), np.concatenate(standing)
    del names, whose, standing
    order = np.lexsort((node, name))
    name, node, stands = name[order], node[order], stands[order]
    groups = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    stands = np.logical_or.reduceat(stands, groups)
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (node[1:] != node[:-1])])
    name, node = name[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(first, len(name)))
    large = (size > SMALL_GROUP) | stands
    one, two = [], []
    for k in np.unique(size[(size > 1) & ~large]).tolist():
        at = first[(size == k) & ~large]
        for i in range(k):
            for j in range(i + 1, k):
                one.append(node[at + i])
                two.append(node[at + j])
    if one:
        yield from _pairs(np.concatenate(one), np.concatenate(two))
    if large.any():
        yield from _starred(first, large, size, name, node)


def _near(percent: int):
    """Keeps the pairs whose sketches and sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                sketch_distance(x, y) <= most_different(n, k, percent) and 100 * min(n, k) >= percent * max(n, k)
                for n, k, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))
            ]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return run


def _verify(percent: int, words: int):
    """Of the pairs (a, b, the text of a, the text of b) those whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "ta"):
                for piece in slices(half, "tb"):
                    one, two = (dict.fromkeys(piece.column(c).to_pylist()) for c in ("ta", "tb"))
                    known = list(one | two)
                    sets = dict(zip(known, shingle_sets(pa.array(known, pa.string()), words)))
                    kept = []
                    for x, y in zip(piece.column("ta").to_pylist(), piece.column("tb").to_pylist()):
                        x, y = sets[x], sets[y]
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
                    yield piece.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return run


def _widened(words: int):
    """Adds a class's wide sketch to its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                wide = [sketch(s, 2) for s in shingle_sets(piece.column("text"), words)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(wide, pa.binary())], [*piece.schema.names, "wide"])

    return run


def _folded(sketches: pd.Series, cells: int) -> np.ndarray:
    """Sketches of one length, one in a row, folded to ``cells``."""
    out = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while out.shape[1] * 64 > cells:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def _block_pairs(percent: int, nearest: bool):
    """Compares the probers of a block with the probed of another; keeps what wide sketches allow.

    Classes of one component are not compared.  ``nearest``: of a prober's partners in one component
    only the closest, as one link is enough.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.assign(cells=rows.wide.str.len() * 8)
        one, two = rows[rows.side == 0], rows[rows.side == 1]
        for (cells, left), (other, right) in ((x, y) for x in one.groupby("cells") for y in two.groupby("cells")):
            fewer = int(min(cells, other))
            x, y = _folded(left.wide, fewer), _folded(right.wide, fewer)
            (n, a, la), (k, b, lb) = ([side[c].to_numpy() for c in ("n", "a", "label")] for side in (left, right))
            for i in range(len(left)):
                ok = np.flatnonzero((lb != la[i]) & (100 * np.minimum(n[i], k) >= percent * np.maximum(n[i], k)))
                far = np.bitwise_count(x[i] ^ y[ok]).sum(1, dtype=np.int64)
                fits = far <= (n[i] + k[ok]) * (100 - percent) // (100 + percent)
                ok, far = ok[fits], far[fits]
                if nearest and len(ok) > 1:
                    order = np.argsort(far, kind="stable")
                    ok = ok[order[np.unique(lb[ok[order]], return_index=True)[1]]]
                if len(ok):
                    found.append(np.stack([np.minimum(a[i], b[ok]), np.maximum(a[i], b[ok])], 1))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def _hash(text: str | Column = "text") -> Column:
    return F.xxhash64(text)


def similar_texts(docs: DataFrame, percent: int = 75, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links that connect what is similar in ``docs`` (``doc_id``, ``text``): a subset of the similarity join with itself.

    Returns ``(documents, links)``: one row ``(doc_id, n_shingles, class, hash)`` for each document, the hash
    being its text's, and one row ``(a, b)`` for each link found between classes of equal sets.  All links between
    different components of the rest are there; inside a component there may be more links than
    are listed.  Documents without words have an empty set and no links.  ``doc_id`` is a whole
    number; it may be null or repeated, with equal texts or others.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    docs = docs.select("doc_id", "text")
    sent = docs.withColumn("hash", _hash()).mapInArrow(_signal(percent, words, parts), _SENT)
    told = materialise(sent.repartitionById(parts, "part").mapInArrow(_group, _TOLD), "told")
    texts = materialise(told.where("kind = 'doc'").select("doc_id", "n", "a", "b"), "docs")
    classes = materialise(told.where("kind = 'class'").select("a", "n", "spare", "sketch").dropDuplicates(["a"]), "classes")
    common = materialise(told.where("kind = 'common'").select("a", F.col("b").alias("sig")).distinct(), "common")
    heads = texts.where("n > 0").groupBy("a").agg(F.min(F.struct("doc_id", "b")).alias("head"))

    def held(wanted: DataFrame, name: str) -> DataFrame:
        """``(a, text)``: one text of each class of ``wanted``, found again by its hash and id, as neither needs to be there once only."""
        places = materialise(wanted.distinct().join(heads, "a").select("a", F.col("head.doc_id").alias("_id"), F.col("head.b").alias("_hash")), "places")
        found = docs.join(small(places), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == _hash()))
        out = materialise(found.groupBy("a").agg(F.first("text").alias("text")), name)
        discard(places)
        return out

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs that their narrow sketches allow."""
        side = lambda x: classes.select(F.col("a").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return materialise(pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(percent), "a long, b long"), "likely")

    def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The pairs whose sets have the similarity; ``whole`` has the texts of their classes."""
        ends = materialise(_ends(pairs), "ends")
        few = whole.join(small(ends), "a", "left_semi")
        text = lambda x: few.select(F.col("a").alias(x), F.col("text").alias(f"t{x}"))
        found = materialise(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify(percent, words), "a long, b long"), "links")
        discard(ends)
        return found

    pairs = likely(told.where("kind = 'pair'").select("a", "b"))
    discard(told)
    whole = held(_ends(pairs), "texts")
    links = verified(pairs, whole)
    discard(pairs, whole)
    open_ = _open_groups(common, links)
    found = texts.select("doc_id", F.col("n").alias("n_shingles"), F.col("a").alias("class"), F.col("b").alias("hash"))
    if open_.isEmpty():
        discard(open_, classes, common)
        return found, links
    texts_held = held(open_.select("a"), "texts")
    whole = materialise(texts_held.mapInArrow(_widened(words), "a long, text string, wide binary"), "members")
    discard(texts_held)
    # The best linked member of a group's largest component is held against the other components.
    ends = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("degree"))
    ranked = open_.join(ends, "a", "left").groupBy("sig", "label").agg(F.count("*").alias("many"), F.max(F.struct(F.coalesce("degree", F.lit(0)), F.col("a").alias("hub"))).alias("best"))
    hubs = ranked.groupBy("sig").agg(F.max(F.struct("many", "best", "label")).alias("x")).select("sig", F.col("x.best.hub").alias("hub"), F.col("x.label").alias("of"))
    pairs = likely(open_.join(hubs, "sig").where("label != of").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")))
    links = links.union(verified(pairs, whole))
    # First the closest partners, as most components meet through them; then all that are left.
    for nearest in (True, False):
        discard(open_)
        open_ = _open_groups(common, links)
        pairs = materialise(_compared(open_, classes, whole, percent, nearest).distinct(), "pairs")
        links = links.union(verified(pairs, whole))
    discard(open_, whole, common, classes)
    return found, links


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()


def _open_groups(common: DataFrame, links: DataFrame) -> DataFrame:
    """``(sig, a, label)`` of the large groups whose members are in several components so far."""
    labels = components(links)
    marked = common.join(labels, F.col("a") == F.col("node"), "left").select("sig", "a", F.coalesce("label", "a").alias("label"))
    marked = materialise(marked, "marked")
    several = marked.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    out = materialise(marked.join(several, "sig"), "open")
    discard(marked, labels)
    return out


def _compared(open_: DataFrame, classes: DataFrame, whole: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Candidates ``(a, b)`` of groups in several components, where one at least has too few signatures elsewhere.

    Of two similar texts, the one whose shown segments end first agrees with the other on all of its
    signatures but ``h``: on more than its spare ones.  If no more of them than these are of open
    groups, the two have met elsewhere.  If there are more, they meet in any choice of open groups
    that leaves out no more than the spare number.  So such a text is held against all members of its
    open groups but the largest ones, whatever those members show elsewhere.

    Groups around the same component, of those in them the one that is in most, are compared as one: near
    copies and texts with one passage share most of such groups, and so meet once.  In it, every block
    of the ones meets every block of the others.
    """
    wants = open_.groupBy("a").count().join(classes.select("a", "spare"), "a").select("a", (F.col("count") - F.col("spare")).alias("wants")).where("wants > 0")
    many = open_.groupBy("sig").agg(F.count("*").alias("many"))
    smallest = F.row_number().over(W.partitionBy("a").orderBy("many", "sig"))
    chosen = materialise(open_.join(wants, "a").join(many, "sig").withColumn("rank", smallest).where("rank <= wants").select("sig", "a", "label"), "chosen")
    members = materialise(open_.join(chosen.select("sig").distinct(), "sig", "left_semi"), "met")
    weights = members.groupBy("label").agg(F.count("*").alias("weight"))
    around = members.select("sig", "label").distinct().join(weights, "label").groupBy("sig").agg(F.max(F.struct("weight", "label")).getField("label").alias("around"))
    every_one = lambda rows: rows.join(around, "sig").groupBy("around", "a", "label").agg(F.lit(1).alias("there"))
    members = every_one(members).join(every_one(chosen).withColumnRenamed("there", "probing"), ["around", "a", "label"], "left")
    members = materialise(members.join(classes.select("a", "n"), "a"), "members")
    outside, probing = F.col("label") != F.col("around"), F.col("probing").isNotNull()
    # Those outside that component are held against all; those in it against the others outside.
    meetings = [(outside & probing, F.lit(True)), (~outside & probing, outside)]
    blocks = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
    sizes = members.groupBy("around").agg(*[blocks(which).alias(f"{side}{k}") for k, sides in enumerate(meetings) for side, which in zip(("is", "js"), sides)])
    members = members.join(sizes, "around").where(" or ".join(f"is{k} > 0 and js{k} > 0" for k in range(len(meetings))))
    members = members.join(whole.select("a", "wide"), "a").withColumn("h", F.xxhash64("a"))
    # All places of a member in one pass: which side it is on in which meeting, its own block there and every block of the others.
    places = []
    for k, (those, probed) in enumerate(meetings):
        there = F.col(f"is{k}") > 0
        for side, (which, own, every) in enumerate(((those, f"is{k}", f"js{k}"), (probed, f"js{k}", f"is{k}"))):
            mine = F.pmod("h", F.col(own)).cast("int")
            dealt = F.transform(F.sequence(F.lit(0), F.col(every) - 1), _place(k, side, mine))
            places.append(F.when(there & (F.col(f"js{k}") > 0) & which, dealt).otherwise(F.array().cast("array<struct<meeting:int,side:int,i:int,j:int>>")))
    rows = members.select("around", "a", "label", "n", "wide", F.explode(F.concat(*places)).alias("at")).select("around", "at.*", "a", "label", "n", "wide")
    return rows.groupBy("around", "meeting", "i", "j").applyInPandas(_block_pairs(percent, nearest), "a long, b long")


def _place(meeting: int, side: int, mine: Column) -> Callable[[Column], Column]:
    """The place of a member of block ``mine`` in its meeting with a block of the other side."""

    def of(block: Column) -> Column:
        i, j = (block, mine) if side else (mine, block)
        return F.struct(F.lit(meeting).alias("meeting"), F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    return of


def labelled(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """``(doc_id, n_shingles, hash, label)`` of each row of ``docs``: rows with words and one label are one component."""
    texts, links = similar_texts(docs, percent, words)
    labels = components(links)
    return texts.join(labels, F.col("class") == F.col("node"), "left").select("doc_id", "n_shingles", "hash", F.coalesce("label", "class").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id``, the smallest ``doc_id`` that links reach, for each row of ``docs``.

    Empty and null texts are alone.  Repeated rows are copies and so linked; rows with one ``doc_id``
    and other texts are rows of their own.  A null ``doc_id`` is a component's id only if no row of it has another.
    """
    rows = materialise(labelled(docs, percent, words), "labelled")
    least = rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = rows.where("n_shingles > 0").join(least, "label", "left")
    return full.select("doc_id", "n_shingles", "component_id").unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def first_of_each(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the first of their near duplicates: the one with the smallest ``doc_id``, null last.

    ``doc_id`` is a whole number; it may be null or repeated.  Rows are known again by it and their text's
    hash, so that ``docs`` is read twice and not copied.  Of one id's texts in a component that of the smallest
    hash stays, of rows with equal ids and texts the first.  Rows without words stay.
    """
    names = docs.columns
    hidden = [f"_doc_{i}" for i in range(len(names))]
    rows = docs.toDF(*hidden)
    own = lambda c: F.col(hidden[names.index(c)])
    found = materialise(labelled(rows.select(own("doc_id").alias("doc_id"), own("text").alias("text")), percent, words), "labelled")
    keys = materialise(found.where("n_shingles > 0").groupBy("label", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(F.count("*").alias("many")), "keys")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "many")
    first = materialise(keys.groupBy("label").agg(F.min(order).alias("x")).select(F.col("x._id").alias("_first"), F.col("x._hash").alias("_its"), F.col("x.many").alias("many")), "first")
    single = first.where("many = 1").drop("many")
    gone = materialise(keys.join(single, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_its")), "left_anti").select("_id", "_hash"), "gone")
    again = materialise(first.where("many > 1").select(F.col("_first").alias("_id"), F.col("_its").alias("_hash")), "again")
    discard(found, keys, first)
    same = F.col("_id").eqNullSafe(own("doc_id")) & (F.col("_hash") == _hash(own("text")))
    stay = rows.join(small(gone), same, "left_anti")
    if again.isEmpty():
        discard(again)
        return stay.toDF(*names)
    # Of rows that are equal in id and text, all of which are in ``gone``, the first comes back.
    copies = rows.withColumn("_place", F.monotonically_increasing_id()).join(small(again), same, "left_semi")
    one = copies.groupBy(own("doc_id"), _hash(own("text"))).agg(F.min_by(F.struct(*hidden), "_place").alias("row")).select("row.*")
    return stay.union(one).toDF(*names)
