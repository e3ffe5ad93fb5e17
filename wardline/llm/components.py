"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import kept


def _jumped(parent: DataFrame) -> DataFrame:
    """Pointer doubling: every node gets the root above it."""
    while True:
        above = parent.select(F.col("parent").alias("via"), "node")
        up = parent.select(F.col("node").alias("via"), F.col("parent").alias("top"))
        parent = kept(above.join(up, "via", "left").select("node", F.coalesce("top", "via").alias("parent"),
                                                           (F.col("top") != F.col("via")).alias("moved")))
        if parent.where("moved").isEmpty():
            return parent.drop("moved")
        parent = parent.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for each node of the edges (a, b).

    Rounds of hooking to the smallest neighbour, pointer doubling and contraction; the contracted edges
    shrink each round, and every table lies in the shared folder. Nothing reaches the driver but
    whether edges are left.
    """
    edges = kept(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = _jumped(hooked.select("node", F.least("node", "least").alias("parent")))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("label"))
        else:
            moved = parent.select(F.col("node").alias("label"), F.col("parent").alias("to"))
            labels = kept(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        a = parent.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        edges = kept(edges.join(a, "a").join(b, "b").where("ra != rb")
                     .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
