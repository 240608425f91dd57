"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)``: the smallest node that each linked node reaches.

    Every round gives a node the smallest label around it and then the label of that label, so
    paths shorten by more than half.  Links stay in a table; only a count comes to the driver.
    An empty link table has no nodes.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = materialise(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumn("fell", F.lit(True)), "labels")
    while not labels.where("fell").isEmpty():
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("near"))
        nearer = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        after = nearer.join(of_label, F.col("label") == F.col("via"), "left").select("node", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("was")).alias("fell"))
        before, labels = labels, materialise(after, "labels")
        discard(before)
    discard(both)
    out = labels.drop("fell")
    out._written_to = labels._written_to
    return out
