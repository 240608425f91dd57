"""How filters act on each other, in every order that they can be applied in.

Each filter's failing documents are one table of ids.  What a prefix of an order leaves only depends
on the set of its filters, so the prefixes of all orders are 32 sets for five filters.  Anti joins
with the tables of a set leave its survivors; a filter's failing ids lose those of the sets before
it by anti joins (removed there) and keep them by a semi join (redundant there).  All tables are
written in buckets of the id, so these joins shuffle nothing; only counts leave their tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise, scratch


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _upper(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))


#: What fails a document, by filter: conditions on its words and its text.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda words, text: F.size(words) < 100,
    "B": lambda words, text: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda words, text: 100 * _upper(text) > 10 * F.length(text),
    "D": lambda words, text: text.rlike(r"[#$%&*|]"),
}
#: The filter of documents whose text a smaller id has too.
REPEATED = "E"


class _Bucketed:
    """A table in buckets of ``row``, and perhaps in one folder for each filter."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark, self.name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
        path = f"{scratch(self.spark)}/{self.name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Dealt by the same rule as the buckets are, so that each bucket is one file.
        writer = df.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", path)
        (writer.partitionBy(by) if by else writer).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        self.rows._written_to = path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        discard(self.rows)


def _facts(docs: DataFrame, rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """One row for each document: its number, part, a digest of its text and which rules it fails."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", _words(F.col("text")))
    fails = [rule(F.col("words"), F.col("text")).alias(f"fails_{x}") for x, rule in rules.items()]
    return split.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *fails)


def _without(ids: DataFrame, failing: DataFrame, filters: str, own: bool) -> DataFrame:
    """``ids`` once for each set of filters (``before``) that none of whose filters it fails.

    Every filter doubles the rows: one goes on without it, the other only if it is not among the
    filter's failing ids.  ``own``: a row's own filter is in no set.
    """
    out = ids.withColumn("before", F.lit(""))
    for x in filters:
        both = F.array(F.lit(False), F.lit(True))
        out = out.withColumn("after", F.explode(F.when(F.col("filter") == x, F.array(F.lit(False))).otherwise(both) if own else both))
        of = failing.where(F.col("filter") == x).select(F.col("row").alias("gone"))
        out = out.join(of, (F.col("row") == F.col("gone")) & F.col("after"), "left_anti")
        out = out.withColumn("before", F.concat("before", F.when(F.col("after"), x).otherwise(""))).drop("after")
    return out


def _orders(spark, filters: str) -> DataFrame:
    """Each step of each order: ``n, filter_order, step, filter``, the set ``before`` it and the one ``after`` it."""
    steps = []
    for order in permutations(filters):
        for k, x in enumerate(order):
            steps.append((len(steps), "".join(order), k + 1, x, "".join(sorted(order[:k])), "".join(sorted(order[: k + 1]))))
    return F.broadcast(spark.createDataFrame(steps, "n int, filter_order string, step int, filter string, before string, after string"))


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column, Column], Column]] = RULES, repeated: str = REPEATED) -> DataFrame:
    """What each filter does at each step of each order, by language of ``docs`` (``doc_id, text, lang``).

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    Null texts are empty, a null language is the part ``''``.  Rows are told apart by their place: each row
    of a repeated id counts, and equal texts under one id do not repeat each other.  A row without an id
    repeats nothing and has no label.  A label with quality or toxic 1 in any row of its id counts.  No
    documents give no rows.
    """
    spark, filters = docs.sparkSession, "".join(sorted([*rules, repeated]))
    facts = materialise(_facts(docs, rules), "facts")
    least = materialise(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "least")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = materialise(labels.groupBy("doc_id").agg(is_one("quality"), is_one("toxic")).where("quality or toxic"), "marks")
    marked = facts.join(marks, "doc_id", "left").join(least, "digest", "left")
    fails = [F.when(F.col(f"fails_{x}") if x in rules else F.col("doc_id") > F.col("least"), x) for x in filters]
    failed = marked.select("row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")], F.explode(F.array_compact(F.array(*fails))).alias("filter"))
    failing = _Bucketed(failed, "failing", by="filter")
    everyone = _Bucketed(facts.select("row", "part"), "everyone")
    discard(facts, least, marks)

    own = failing.rows.select("row", "part", "quality", "toxic", "filter")
    kept = materialise(_without(everyone.rows, failing.rows, filters, own=False).groupBy("part", F.col("before").alias("after")).agg(F.count("*").alias("kept")), "kept")
    lost = [F.count_if(F.col(c)).alias(x) for c, x in (("quality", "good_lost"), ("toxic", "toxic_lost"))]
    removed = materialise(_without(own, failing.rows, filters, own=True).groupBy("part", "filter", "before").agg(F.count("*").alias("removed"), *lost), "removed")
    sets = ["".join(c) for k in range(len(filters)) for c in combinations(filters, k)]
    before = F.filter(F.array(*map(F.lit, sets)), lambda s: ~F.contains(s, F.col("filter")))
    earlier = failing.rows.select(F.col("row").alias("gone"), F.col("filter").alias("by"))
    redundant = own.withColumn("before", F.explode(before)).join(earlier, (F.col("row") == F.col("gone")) & F.contains("before", F.col("by")), "left_semi")
    redundant = materialise(redundant.groupBy("part", "filter", "before").agg(F.count("*").alias("redundant")), "redundant")
    failing.drop()
    everyone.drop()

    # From here on there are a few counts for each part.
    orders = _orders(spark, filters)
    parts = kept.where(F.col("after") == "").select("part", F.explode(F.sequence(F.lit(0), F.lit(math.factorial(len(filters)) * len(filters) - 1))).alias("n"))
    alone = removed.where(F.length("before") == len(filters) - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = parts.join(orders, "n").join(kept, ["part", "after"], "left")
    for counts, keys in ((removed, ["part", "filter", "before"]), (redundant, ["part", "filter", "before"]), (alone, ["part", "filter"])):
        steps = steps.join(counts, keys, "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shapley = F.sum(F.coalesce("removed", F.lit(0))).over(W.partitionBy("part", "filter")).alias("shapley")
    return steps.select("part", "filter_order", "step", *map(number, ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley)


SQL = """
WITH lab AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS tox
             FROM labels GROUP BY doc_id),
     d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
     f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.tox, 0) AS tox,
                  concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                         CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                         CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
                         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                         CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
           FROM w LEFT JOIN lab l ON w.doc_id = l.doc_id),
     c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM f GROUP BY part, fails),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
     o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
     s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before
           FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) k),
     g AS (SELECT *, contains(fails, filter) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM s, c),
     r AS (SELECT part, filter_order, step, filter,
                  sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN tox ELSE 0 END) AS toxic_lost
           FROM g GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
