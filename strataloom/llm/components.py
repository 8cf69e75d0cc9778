"""Connected components of a link table, by label propagation with pointer jumping, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node reachable, for nodes that have a link.

    Each round takes the least label among the neighbours (partially aggregated, so that a node with very
    many links is no hot group) and then the label's own label, so chains shrink by half or better. Every
    round's labels are written to the shared folder. No links give no rows; repeated links, both
    directions and loops do no harm.
    """
    both = S.materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = S.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        new = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = new.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        new = S.materialise(new)
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels
