"""Connected components over a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import staged


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of `links` (a, b): the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of the
    label. Labels are summed up per node before they are shuffled, so that a node with very
    many links is no hot key, and every round is written to the shared folder.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(
        spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")), name,
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = staged(
            spark, lowered.join(of, "label").select("node", "old", F.least("label", "further").alias("label")), name,
        )
        changed = jumped.where(F.col("old") != F.col("label")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
