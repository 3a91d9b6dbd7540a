"""Connected components of a link table, by spreading the smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize


def connected(links: DataFrame, tag: str = "labels") -> DataFrame:
    """node, label (the smallest id reachable) of every id in links (a, b).

    Each round takes the smallest label of the neighbours, then that label's own label, so rounds grow with
    the logarithm of the longest path. Links and labels are tables in the shared folder, never collected.
    """
    both = links.filter("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-links")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), tag)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").withColumn("to", F.least("label", "near"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        spread = materialize(met.join(jump, "to").select("node", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") < F.col("label")).alias("changed")), tag)
        labels = spread.select("node", "label")
        if spread.filter("changed").isEmpty():
            return labels
