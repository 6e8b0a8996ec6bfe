"""Connected components as DataFrame joins: by minimum labels and pointer jumping, or by contraction.

Minimum labels need as many rounds as the longest chain asks for, each over all edges;
contraction halves the graph, so that long chains cost no more than a few rounds.

Every round of labels is two equi joins and two aggregations with map-side combine. A hub
with very many neighbours is only ever a join key against one label row, which
adaptive execution splits, or an aggregation key that is combined before the
shuffle. Nothing is collected but the number of changed labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.scratch import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of an undirected edge table.

    ``component`` is the smallest node of the connected component. Repeated edges
    and self loops are harmless; edges with a null end are ignored; an empty table
    gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialize(labels, "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = step.select(F.col("node").alias("at"), F.col("label").alias("root"))
        jumped = step.join(root, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        jumped = materialize(jumped, "cc-labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def contracted_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node with an edge to another one; ``component`` is its smallest node.

    Each round, a node goes over to whichever of itself and its neighbours has the least
    hash, with a new hash in every round, and edges are drawn between what is left: about
    half of the nodes of a chain stay, whatever the order of their ids. Only what each
    round merged is kept, and composed at the end.
    """
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = materialize(e.distinct(), "cc-edges")
    merged = []
    while not merged or not e.isEmpty():
        number = lambda c, k=len(merged): F.xxhash64(F.lit(k), c)
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = both.groupBy("node").agg(F.min_by("other", number("other")).alias("other"))
        into = materialize(near.select("node", F.when(number("other") < number("node"), F.col("other")).otherwise(F.col("node")).alias("into")), "cc-into")
        merged.append(into)
        side = lambda c, i=into: i.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"))
        left = e.join(side("a"), "a").join(side("b"), "b").where("a_into <> b_into")
        e = materialize(left.select(F.least("a_into", "b_into").alias("a"), F.greatest("a_into", "b_into").alias("b")).distinct(), "cc-edges")
    found = merged.pop()
    while merged:
        later = found.select(F.col("node").alias("into"), F.col("into").alias("last"))
        found = merged.pop().join(later, "into", "left").select("node", F.coalesce("last", "into").alias("into"))
    found = materialize(found, "cc-labels")
    return found.join(found.groupBy("into").agg(F.min("node").alias("component")), "into").select("node", "component")
