"""Fingerprints and their components against plain definitions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from colligo.llm import simhash

DOCS = "doc_id long, text string, lang string, mark string"
HARD = [None, "", " \n\t ", "word", "WORD", "a b c d", "A\tb\n\nC d", "a b c d e", "x " * 3000, "é ü 漢字 😀 \x85 \xa0 ſ", "a b a b a b a b a b"]


def plain_print(text):
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, ids, most=4):
    label = list(range(len(marks)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= most:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(marks))]


def test_fingerprints_against_python(monkeypatch):
    monkeypatch.setattr(simhash, "HASHED", 700)
    rng = random.Random(3)
    texts = HARD + [" ".join(rng.choice("abcdé") * rng.randrange(1, 4) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [plain_print(t) for t in texts]
    assert not len(simhash.fingerprints(pa.array([], pa.string())))


@pytest.mark.parametrize(("most", "leaf"), [(4, 5), (3, 1 << 13), (1, 40)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, most, leaf):
    """Random fingerprints, dense clusters of which one is larger than a leaf, and neighbours over both halves."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng, marks = random.Random(most), set()
    for size, spread in ((60, 64), (60, 5), (1, 0)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            marks.add(rng.getrandbits(64) if spread == 64 else centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread + 1))))
    for x in list(marks)[:60]:
        for high in range(most + 2):
            marks.add(x ^ sum(1 << b for b in rng.sample(range(32, 64), high)) ^ sum(1 << b for b in rng.sample(range(32), most - min(high, most))))
    marks = sorted(marks)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in marks], "mark long")
    label = {x: x for x in marks}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in simhash.links(df, most).collect():
        a, b = (root(v % (1 << 64)) for v in (r["a"], r["b"]))
        label[max(a, b)] = min(a, b)
    got, want = [root(x) for x in marks], plain_components(marks, marks, most)
    assert got == want


def test_rows_and_components(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = list(HARD)
    for _ in range(30):
        own = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(own))
        for _ in range(3):
            changed = own[:]
            for k in rng.sample(range(400), rng.randrange(4)):
                changed[k] = "other"
            texts.append(" ".join(changed))
    ids = [*range(len(texts)), None, None, 3, 3]
    texts += ["nobody else has this text", texts[20], texts[20], "an id that is there twice"]
    rows = [(d, t, None, "clash") for d, t in zip(ids, texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    marks = [plain_print(t) for t in texts]
    want = list(zip(ids, (f"{m:016x}" for m in marks), plain_components(marks, ids)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({c for _, _, c in want}) < len(set(texts)) - 20  # near copies are linked
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
