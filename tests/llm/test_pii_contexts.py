"""Operator 1's added spans against a plain version of the bootstrapping, on one machine and without Spark."""

from __future__ import annotations

import collections
import math
import random
import re

from colligo.llm import pii

WORDS = re.compile(r"(?:([^\W\d_]{2,24}[:=#]?)[ \t]+)?([^\W\d_]{2,24}[:=#]?)[ \t\"'(]{0,3}\Z")
RUN = re.compile(r"[A-Za-z0-9@._+()-]+")


def contexts(before: str) -> list[str]:
    m = WORDS.search(before[-48:])
    if not m:
        return []
    return [m[2].lower()] + ([f"{m[1]} {m[2]}".lower()] if m[1] else [])


def loose(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Runs between the base spans, each wholly a candidate or none."""
    for _, s, e in base:
        text = text[:s] + "+" * (e - s) + text[e:]
    out = []
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        if run[0] in "+(":
            run, first = run[1:], 1
        else:
            first = 0
        if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9@._()-]{5,}", run) and re.search("[0-9@]", run[1:]):
            out.append((at, at + first + len(run), m[0]))
    return out


def plain(texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    found = []
    for text, spans in zip(texts, base):
        rows, kinds = [], collections.defaultdict(int)
        for kind, s, e in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])):
            rows.append((kind, s, e, text[s:e], contexts(text[kinds[kind] : s])))
            kinds[kind] = e
        ends = 0
        for s, e, value in loose(text, spans):
            masked = text
            for _, a, b in spans:
                masked = masked[:a] + "+" * (b - a) + masked[b:]
            if c := contexts(masked[ends:s]):
                rows.append(("", s, e, value, c))
            ends = e
        found.append(rows)
    edges = {(c, value, kind) for rows in found for kind, _, _, value, cs in rows for c in cs}
    total = collections.Counter(c for c, _, _ in edges)
    seeds = {(value, kind): 1.0 for _, value, kind in edges if kind}
    sure = dict(seeds)
    for _ in range(pii.ROUNDS):
        good, support = collections.Counter(), collections.Counter()
        by_value = collections.defaultdict(list)
        for (value, kind), score in sure.items():
            by_value[value].append((kind, score))
        for c, value, _ in edges:
            for kind, score in by_value[value]:
                good[c, kind] += score
                support[c, kind] += 1
        patterns = {k: good[k] / (total[k[0]] + 1) for k in good if support[k] >= pii.SUPPORT}
        doubt = collections.defaultdict(float)
        for c, value, seed in edges:
            for kind in pii.KINDS:
                if not seed and (c, kind) in patterns:
                    doubt[value, kind] += math.log(max(1 - patterns[c, kind], 1e-6))
        sure = dict(seeds)
        for k, d in doubt.items():
            if 1 - math.exp(d) >= pii.CONFIDENCE:
                sure[k] = max(sure.get(k, 0), 1 - math.exp(d))
    best = {}
    for (c, kind), confidence in patterns.items():
        if confidence >= pii.CONFIDENCE:
            best[c] = max(best.get(c, (0, "")), (confidence, kind))
    out = []
    for rows in found:
        more = []
        for kind, s, e, _, cs in rows:
            if not kind and (named := [best[c] for c in cs if c in best]):
                more.append((pii.KINDS.index(max(named)[1]), s, e))
        both = [(pii.KINDS.index(k), s, e) for k, s, e, _, _ in rows if k] + more
        out.append([f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(both)])
    return out


def test_added_spans_against_a_plain_version(spark):
    rng = random.Random(5)
    long = "x" * 90 + "7" + "y" * 40
    seeds = {"tel:": "+1 555 000 {:04d}", "mail": "a{:d}@b.cc", "the fon": "+49 30 00 {:04d}", "Straßentelefonnummernverzeichnisse": "+33 1 00 00 {:04d}", "my own": "a.{:d}@b.c.de"}
    others = ["id{:d}xyz", "ref({:d})-77", "{:d}.{:d}x", "n{:d}@host", "plainword", "(77{:d}88", long + "{:d}"]
    texts = []
    for _ in range(1200):
        name = rng.choice([*seeds, "lot", "host=", "number #", ""])
        parts = []
        for _ in range(rng.randint(1, 3)):
            value = seeds[name] if name in seeds and rng.random() < 0.93 else rng.choice(others)
            parts.append(f"{name} {value.format(*[rng.randrange(10, 9999)] * 2)}{rng.choice([' ', ', ', ' now ', ') '])}")
        texts.append(rng.choice(["", "Say ", "über "]) + "".join(parts))
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    base = [[(x["kind"], x["start"], x["end"]) for x in r["found"]][: r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]] for r in got]
    want = plain(texts, base)
    assert sum(r["n_more"] for r in got) > 50
    for r, w in zip(got, want):
        assert r["spans"] == ",".join(w), (texts[r["doc_id"]], r["spans"], w)


def test_identifiers_of_any_length(spark):
    seeds = [f"Call tel: +1 555 000 {1000 + i} now" for i in range(40)]
    whole = [f"tel: {'9' * n} end" for n in (79, 80, 81, 200, 5000)] + ["tel: " + "a." * 100000 + "7 end", "a" * 300000 + " tel: x1 end"]
    got = pii.detect(spark.createDataFrame(list(enumerate(seeds + whole)), "doc_id long, text string")).where("doc_id >= 40").orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == [f"phone:5:{5 + n}" for n in (79, 80, 81, 200, 5000)] + ["phone:5:200006", ""]
