"""The filters' audit against filters applied one after another."""

import re
from collections import Counter
from itertools import permutations

from colligo.llm import filter_audit

DOCS = "doc_id long, text string, lang string, row long, filter string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(text, doc_id, firsts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return out + "E" * (doc_id is not None and text in firsts and firsts[text] < doc_id)


def plain(docs, labels):
    rows, firsts = [(d, t or "", lang or "") for d, t, lang in docs], {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t] = min(firsts.get(t, d), d)
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    out = []
    for part in {p for *_, p in rows}:
        own, shapley, steps = [(d, fails(t, d, firsts)) for d, t, p in rows if p == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                redundant = sum(x in f and bool(set(f) & set(order[:k])) for _, f in own)
                shapley[x] += len(gone)
                steps.append([part, order, k + 1, len(left), len(gone), redundant, sum(f == x for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_against_filters_in_every_order(spark):
    many = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \n\t", many, many, many + " #", many + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 8, "x " * 300, "x " * 300, "X # " * 80, "é ü 漢字 😀 \x85 \xa0 ſ" * 30, many.replace(" ", "\x0b"), "HIGH", "#", many]
    docs = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts * 2, ["en", None, "", "de"] * 8))]
    docs += [(None, many, "en"), (3, many, "en"), (3, "another text of a known id", "de"), (None, None, None), (-1, "X # " * 80, "fr")]
    labels = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(25)] + [(3, None, None), (3, 0, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0), (4, 1, 0)]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], DOCS)
    got = filter_audit.audit(df, spark.createDataFrame([(*x, "clash") for x in labels], LABELS))
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("failing_", "everyone_"))]


def test_joins_of_id_tables_shuffle_nothing(spark):
    """Beyond broadcasts' reach they are joined bucket by bucket."""
    df = spark.createDataFrame([(i, f"w{i} " * (i % 200), "en", 1, "clash") for i in range(300)], DOCS)
    facts = filter_audit._facts(df, filter_audit.RULES)
    ids = filter_audit._Bucketed(facts.where("fails_A").selectExpr("row", "'A' AS filter"), "failing", by="filter")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = filter_audit._without(ids.rows, ids.rows, "A", own=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        ids.drop()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_no_documents(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
