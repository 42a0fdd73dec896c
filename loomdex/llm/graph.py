"""Connected components of a bounded-degree link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the component's smallest node.

    Each round takes the smallest label among neighbours and then the label of that label, so rounds
    grow with the logarithm of a component's diameter in practice. The loop ends when a round
    changes nothing. Each round's labels are written to the shared folder, and those of the round before deleted.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        known = labels.select("node", "root")
        heard = both.join(known, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("heard"))
        lower = known.join(heard, "node", "left").select("node", F.least("root", "heard").alias("next"), F.col("root").alias("old"))
        lower = written(lower)
        up = lower.select(F.col("node").alias("next"), F.col("next").alias("above"))
        jumped = written(lower.join(up, "next", "left").select("node", F.least("next", "above").alias("root"), "old"))
        drop(labels, lower)
        labels = jumped
        if jumped.filter("root <> old").limit(1).count() == 0:
            drop(both)
            return labels.select("node", "root")
