"""Connected components of an undirected link table, in rounds over written
tables: each node takes the least label among itself and its neighbours, then
the label of its label.  Nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the least
    node of its component."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = (labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = materialize(step.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        if step.where("label <> old").limit(1).count() == 0:
            return step.select("node", "label")
        labels = step.select("node", "label")
