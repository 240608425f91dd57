"""What the near duplicates' stage leaves on disk, and which of equal rows it keeps."""

import random
import string
from pathlib import Path

from colligo.llm import ngram_join
from colligo.llm.common import materialise, scratch

DOCS = "doc_id long, text string, lang string"


def noise(rng, n):
    """Words that hardly compress."""
    return " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=9)) for _ in range(n))


def tables(spark):
    return {str(p) for p in Path(scratch(spark).removeprefix("file:")).iterdir()}


def test_no_texts_are_left(spark):
    """The result reads the input again: no copy of it stays, nor one of the members of groups that were open for a while."""
    rng = random.Random(6)
    passage = noise(rng, 100)
    texts = [f"{passage} {noise(rng, 100)}" for _ in range(100)]
    texts += [t + " more" for t in texts[:20]]
    docs = materialise(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS), "in")
    before = tables(spark)
    kept = ngram_join.first_of_each(docs)
    left = [spark.read.parquet(t) for t in tables(spark) - before]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(100))
    assert left and not [t.columns for t in left if "string" in dict(t.dtypes).values()]


def test_of_rows_with_equal_ids_and_texts_one_stays(spark):
    rng = random.Random(7)
    one, other = noise(rng, 40), noise(rng, 40)
    rows = [(1, one, "a"), (1, one, "b"), (None, one, "c"), (3, one + " x", "d"), (None, other, "e"), (None, other, "f"), (None, None, "g"), (None, None, "h")]
    kept = ngram_join.first_of_each(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted(r["lang"] for r in kept) == ["a", "e", "g", "h"]


def test_shuffle_files_go_with_their_plan(spark, tmp_path):
    """The setting holds for the write only."""
    from colligo.llm.common import SHUFFLE_CLEANUP

    was = spark.conf.get(SHUFFLE_CLEANUP)
    assert materialise(spark.range(1000).repartition(3), "numbers").count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP) == was
