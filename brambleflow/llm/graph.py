"""Connected components of an edge table, by min-label spreading with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (u, v): component is the smallest id reachable.

    Labels and edges stay distributed.  A round takes the smallest label among
    the neighbours and then the label of that label, so a chain of n links needs
    about log n rounds; the loop ends when a round changes nothing.
    """
    pairs = edges.select("u", "v")
    both = settle(pairs.union(pairs.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = settle(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.id == near.u).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = settle(low.join(above, "component", "left").select("id", "old", F.least("component", "above").alias("component")), "labels")
        moved = new.where("old <> component").limit(1).count()
        drop_settled(labels)
        labels = new.select("id", "component")
        if not moved:
            drop_settled(both)
            return labels
