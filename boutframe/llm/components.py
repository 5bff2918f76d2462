"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of that label.
    Both sides of every join are written tables with one row per id on one side, so an adaptive
    join splits the edges of a hub, and minima are combined before they are shuffled.
    """
    ends = edges.select("a", "b").filter("a <> b")
    both = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    first = both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label"))
    labels = written(first, "graph-labels-0")
    n = 0
    while True:
        n += 1
        near = both.join(_named(labels, "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("b_label").alias("near"))
        known = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        known = written(known, f"graph-near-{n}")
        jumped = known.join(_named(labels, "to"), "to").select("id", "was", F.least("to", "to_label").alias("label"))
        jumped = written(jumped, f"graph-labels-{n}")
        labels = jumped.select("id", "label")
        if not jumped.filter("label <> was").head(1):
            return labels.withColumnRenamed("label", "component")


def _named(labels: DataFrame, name: str) -> DataFrame:
    return labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
