"""Connected components of a graph of links, by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import attach_groups, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of a link (a, b): the smallest id that can be reached.

    Each round takes the least label of a node's neighbours, then the label of that
    label, so long chains halve. Neighbours' labels are reduced before the shuffle.
    A node with very many links, and a label that very many nodes have, are joined by
    broadcast (see attach_groups). Rounds end when no label changes.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    total = both.count()
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("degree")).withColumnRenamed("a", "id"))
    while True:
        # links are kept both ways, so b occurs as often as it has links
        near = attach_groups(both, labels.withColumnRenamed("id", "b"), "b", "degree", total)
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "id").select("id", "degree", "label", F.least("label", "near").alias("next")))
        used = step.groupBy("next").agg(F.count("*").alias("n"))
        jump = used.join(step.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("next", "far", "n")
        step = written(attach_groups(step, jump, "next", "n", total).select("id", "degree", "label", F.least("next", "far").alias("next")))
        if step.filter("label != next").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = step.select("id", "degree", F.col("next").alias("label"))
