"""Connected components of links between documents, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendery.session import settle_table


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so long chains
    need about as many rounds as their length has binary digits. Labels are written after each round, which
    cuts the lineage and survives lost executors. A hub's links are joined in parts (skew join) and minima
    are combined before the shuffle.
    """
    both = settle_table(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = settle_table(
        both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("id"))
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("id").alias("of"), F.col("component").alias("beyond"))
        moved = settle_table(
            lower.join(jump, F.col("step") == F.col("of"), "left").select(
                "id", "old", F.least("step", F.coalesce("beyond", "step")).alias("component")
            ),
            "labels",
        )
        labels = moved.select("id", "component")
        if moved.filter("component < old").isEmpty():
            return labels
