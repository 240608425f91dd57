import itertools

import numpy as np
from colligo.operators import clustering, knowledge, matching
from pyspark.sql import functions as F


def test_best_clusters_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        values, weights = np.sort(rng.choice(1440, n, replace=False)).astype(float), rng.integers(1, 9, n).astype(float)
        best = np.inf
        for cuts in itertools.combinations(range(1, n), min(k, n) - 1):
            parts = np.split(np.arange(n), cuts)
            best = min(best, sum((weights[p] * (values[p] - np.average(values[p], weights=weights[p])) ** 2).sum() for p in parts))
        got = clustering.best_clusters(values, weights, k)
        inside = [(values >= a) & (values <= b) for a, b, _ in got]
        cost = sum((weights[m] * (values[m] - c) ** 2).sum() for m, (_, _, c) in zip(inside, got))
        assert len(got) == min(k, n) and abs(cost - best) < 1e-6 and [c for *_, c in got] == sorted(c for *_, c in got)


def test_enrich(spark):
    starts = ["07:00"] * 6 + ["08:00"] * 9 + ["09:00"] * 3 + ["14:00"] * 3 + ["15:00"] * 6 + ["", None]
    rows = clustering.enrich(spark.createDataFrame([(s, "16:00") for s in starts], "shift_start string, shift_end string")).collect()
    of = {r["shift_start"]: r for r in rows}
    assert [of[s]["shift_cluster_id"] for s in ("07:00", "08:00", "09:00", "14:00", "15:00", None)] == [0, 1, 2, 3, 3, -1]
    assert of["15:00"]["detected_shift_type"] == "AFTERNOON" and of[""]["detected_shift_type"] == "UNKNOWN" and of["07:00"]["shift_detection_confidence"] == 1.0
    assert of["14:00"]["shift_detection_confidence"] == 0.67


def test_enrich_needs_two_starts(spark):
    rows = clustering.enrich(spark.createDataFrame([("08:00",), ("x",)], "shift_start string")).collect()
    assert all(r["shift_cluster_id"] == -1 and r["shift_detection_confidence"] == 0.0 for r in rows)


def test_suggest_boundaries(spark):
    rows = [("a", "f", 0.82), ("b", "f", 0.8199), ("c", "f", 0.90), ("c", "g", 0.89), ("d", "f", 0.90), ("d", "g", 0.895), ("e", "f", 0.9), ("e", "f", 0.899)]
    got = {r["column_name"]: (r["status"], r["target_field"]) for r in matching.suggest(spark.createDataFrame(rows, "column_name string, field_name string, confidence double")).collect()}
    assert got == {"a": ("mapped", "f"), "b": ("unmapped", None), "c": ("mapped", "f"), "d": ("ambiguous", None), "e": ("mapped", "f")}


def test_coverage_is_strict(spark):
    m = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.51)], "document_type string, field_name string, adjusted double")
    f = spark.createDataFrame([("t", "a", True), ("t", "b", True), ("t", "c", False), ("u", "z", False)], "document_type string, field_name string, required boolean")
    assert {r["document_type"]: r["coverage"] for r in matching.coverage(m, f).collect()} == {"t": 0.5, "u": 1.0}


def test_nearest_breaks_ties_by_id_and_skips_zeros(spark):
    items = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None)], "item_id int, vector array<double>").repartition(3)
    got = matching.nearest(spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>"), items, 2).orderBy("rank").collect()
    assert [(r["item_id"], r["similarity"]) for r in got] == [(1, 1.0), (3, 1.0)]


def test_conflicts_and_upsert(spark):
    m = spark.createDataFrame([("a", "f", 0.9), ("b", "f", 0.95), ("c", "g", 0.9), ("d", None, 0.1)], "column_name string, target_field string, confidence double")
    assert [tuple(r) for r in matching.conflicts(m).collect()] == [("f", ["b", "a"])]
    new = spark.createDataFrame([("m", "t", "a", "f")] * 2, "vertical string, document_type string, source_column string, target_field string")
    assert knowledge.upsert(knowledge.upsert(None, new), new).first()["occurrence_count"] == 4


def test_by_alias_takes_the_first_field(spark):
    fields = spark.createDataFrame([(1, "b", ["Emp ID"]), (0, "a", ["emp-id"])], "field_position int, field_name string, aliases array<string>")
    assert matching.by_alias(spark.createDataFrame([("EMP_ID",)], "column_name string"), fields).first()["field_name"] == "a"


def test_distinct_tokens(spark):
    from colligo.operators.tokens import distinct_tokens

    rows = spark.createDataFrame([(1, "Emp ID emp  id X"), (2, ""), (3, None), (4, "a\nA b")], "k int, text string")
    assert {r["k"]: r["tokens"] for r in distinct_tokens(rows, "k").collect()} == {1: "Emp ID X", 4: "a b"}


def test_similar_columns_and_suggestions(spark):
    known = spark.createDataFrame([("m", "t", "a", "f", 2, [1.0, 0.0]), ("m", "u", "b", "g", 1, [0.6, 0.8]), ("n", "t", "c", "h", 1, [0.0, 1.0])], "vertical string, document_type string, source_column string, target_field string, occurrence_count long, vector array<double>")
    asked = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "query_id string, vector array<double>")
    got = lambda **k: {(r["query_id"], r["rank"]): (r["source_column"], r["similarity"]) for r in matching.similar_columns(asked, known, 2, **k).collect()}
    assert got() == {("x", 1): ("a", 1.0), ("x", 2): ("b", 0.6), ("y", 1): ("c", 1.0), ("y", 2): ("b", 0.8)}
    assert got(vertical="m", document_type="u") == {("x", 1): ("b", 0.6), ("y", 1): ("b", 0.8)} and got(vertical="z") == {}
    columns = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "source_column string")
    voted = spark.createDataFrame([("x", "p", 0.6), ("y", "q", 0.5), ("w", "r", 0.5)], "source_column string, target_field string, confidence double")
    similar = spark.createDataFrame([("x", "f", 0.6, 1, "a"), ("y", "g", 0.9, 1, "b"), ("y", "h", 0.8, 2, "c")], "source_column string, target_field string, similarity double, rank int, matched_column string")
    rows = {r["source_column"]: tuple(r)[1:] for r in matching.column_suggestions(columns, voted, similar).collect()}
    assert rows == {"x": ("p", 0.6, "similar_tables", None), "y": ("g", 0.9, "column_similarity", "b"), "z": (None, 0.0, "no_match", None), "w": ("r", 0.5, "similar_tables", None)}


def test_distinct_tokens_read_texts_where_they_lie(spark):
    """White space that only Spark takes for such, spellings, texts of one key and of none; texts of different keys are not shuffled."""
    from colligo.operators.tokens import distinct_tokens

    texts = [(1, "The the\tTHE cat\x0bCat  a b ΑΣ ας"), (2, None), (3, " \n "), (4, " x X y"), (5, "İa i̇A")]
    df = spark.createDataFrame(texts, "k long, text string")
    want = {1: "The cat a b ΑΣ", 4: "x y", 5: "İa"}
    alone = distinct_tokens(df, "k")
    assert dict(map(tuple, alone.collect())) == want and "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    more = df.unionByName(spark.createDataFrame([(4, "X z"), (None, "b a"), (None, "B c A")], df.schema))
    assert {r["k"]: r["tokens"] for r in distinct_tokens(more, "k").collect()} == want | {4: "X z y", None: "B a c"}


def test_pairs_of_blocks_are_not_copied():
    """A batch of many pairs costs a worker little more than one pair: what numpy and Python hold at once stays below the batch."""
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(1), 40
    pack = lambda key, rows, width: next(matching._packed(rows, key)(iter([pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(list(rng.normal(size=(rows, width))))], ["query_id" if key == "q" else "item_id", "vector"])])))
    q, i = pack("q", 8, 2000), pack("i", 64, 2000)
    pairs = pa.Table.from_batches([pa.RecordBatch.from_arrays([*q.columns, *i.columns], [*q.schema.names, *i.schema.names])] * n).combine_chunks().to_batches()[0]
    tracemalloc.start()
    found = sum(b.num_rows for b in matching._closest(3, 6, ["query_id", "item_id", "similarity"])(iter([pairs])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * 8 * 3 and most < pairs.nbytes / 10
