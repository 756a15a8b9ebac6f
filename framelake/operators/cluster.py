"""Connected components of similarity edges, by alternating large and small stars.

A hub's neighbours never meet in one task: nodes of more neighbours than a share of all edges are few by that bound, so what their
neighbours need to know is sent to all tasks, and only the others are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Neighbours above which a node counts as a hub, and hubs there can be at most: with more edges the first number grows.
HUB, HUBS = 10_000, 20_000


def _star(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """Neighbours of each node move to the least of them and the node: those above the node (large), or those below it. Nodes of more than
    `hub` neighbours (None: there are none) are told by broadcast."""
    near = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    if hub is None:
        met = near.join(least.select("a", "m"), "a")
    else:
        hubs = F.broadcast(least.where(F.col("n") > hub).select(F.col("a").alias("h"), F.col("m").alias("hm")))
        told = near.join(hubs, F.col("a") == F.col("h"), "left")
        met = told.where("h IS NULL").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a").select("a", "b", "m")
        met = met.union(told.where("h IS NOT NULL").select("a", "b", F.col("hm").alias("m")))
    moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """The number of edges (a, b < a), that of nodes that are in the way of each component's being a star around its least node (nodes
    with several edges down, or with one down and one up), and the most neighbours that a node has."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    still_open = F.count_if((F.col("down") > 1) | (F.col("down") == 1) & (F.col("up") > 0))
    return nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), still_open, F.coalesce(F.max(F.col("down") + F.col("up")), F.lit(0))).first()[:]


def components(links: DataFrame, hub: int = HUB, hubs: int = HUBS) -> DataFrame:
    """(node, label) of every node in `links` (a, b), whose label is the least node that links lead to.

    Edges only ever move to smaller ends, so the rounds end; their number grows with the logarithm of the largest
    component, and ends with the round that makes stars of all components. Each round is cut, and only three numbers a round
    reach the driver. A self link gives no node. A node with more neighbours than `hub`, or than 2 / `hubs` of all edges if that is
    more, is a hub; by that there are at most `hubs` of them.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n, still_open, degree = _state(edges)
        if not still_open:
            break
        # The large star leaves no node with more neighbours below it than it had, so the small one has no more hubs.
        most = max(hub, 2 * n // hubs)
        most = most if degree > most else None
        edges = cut(_star(_star(edges, True, most), False, most))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def label_all(photos: DataFrame, links: DataFrame, key: str = "key") -> DataFrame:
    """`photos` with the column component: the least key of the group; photos without links are groups of one."""
    labels = components(links).withColumnRenamed("node", key).withColumnRenamed("label", "component")
    return photos.join(labels, key, "left").withColumn("component", F.coalesce("component", key))
