"""Connected components of a graph given as edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starloom.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node of the component.

    Every round takes the least label among a node and its neighbours and then the
    label of that label, so stars end after two rounds and paths after about as many
    as the logarithm of their length. Rounds are written; the driver sees one number
    a round. Hubs are joined on (which AQE splits) or summed up before a shuffle.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut_lineage(pairs.union(pairs.select("v", "u")).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = cut_lineage(lower.join(up, lower.label == up._n).select("node", "old", F.least("label", "_l").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels
