"""Connected components by contraction: nodes follow their least neighbours, and the trees that they form are the nodes of the next round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communa.storage import drop, materialize

MAX_ROUNDS = 60


def component_edges(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of comparable ids -> (u, component) for every u that is not the least id of its component.

    In a round each node that has a lesser neighbour follows the least, links are followed to the root of each tree, its least id, and pairs are
    put between roots; those inside a tree go. A node that follows none has a neighbour whose root is no greater, so two rounds halve the nodes at least.
    Pairs are read for one aggregation with map-side combining and two joins with the nodes; that they are stars around the least id already is
    told by one aggregation, not by a round. Self-pairs and null ends take no part; repeated pairs count once.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v"))
    trees: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if _stars(now):
            return _joined(trees, now.select("u", F.col("v").alias("component")).distinct())
        roots = _roots(now)
        step = materialize(_between(now, roots))
        drop(now)
        trees.append(roots)
        now = step
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether each u of (u, v), v < u, has one v and is no v: then v is the least of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.lit(None).alias("y")))).alias("e"))
    told = ends.groupBy("e.x").agg(F.min("e.y").alias("least"), F.max("e.y").alias("most"), F.count("e.y").alias("ups"), F.count("*").alias("n"))
    return not told.filter("least <> most or (ups > 0 and n > ups)").limit(1).count()


def _roots(edges: DataFrame) -> DataFrame:
    """(u, root), written: each node of (u, v), v < u, with a lesser neighbour follows the least, and its links lead to root."""
    now = materialize(edges.groupBy("u").agg(F.min("v").alias("root")))
    while True:
        ahead = now.select(F.col("u").alias("root"), F.col("root").alias("_next"))
        step = materialize(now.join(ahead, "root", "left").select("u", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        drop(now)
        now = step
        if not now.filter("_on").limit(1).count():
            return now.select("u", "root")


def _between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (u, v), v < u, of the roots of edges' ends where they differ."""
    a, b = roots.withColumnRenamed("root", "_a"), roots.select(F.col("u").alias("v"), F.col("root").alias("_b"))
    ends = edges.join(a, "u").join(b, "v", "left").select("_a", F.coalesce("_b", "v").alias("_b")).filter("_a <> _b")
    return ends.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct()


def _joined(trees: list[DataFrame], last: DataFrame) -> DataFrame:
    """(u, component) of all rounds from the roots of each and the stars of the last."""
    for roots in reversed(trees):
        ahead = last.select(F.col("u").alias("root"), "component")
        last = roots.join(ahead, "root", "left").select("u", F.coalesce("component", "root").alias("component")).union(last)
    return last


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node with its component, named by the least node id in it; isolated nodes are their own component."""
    stars = component_edges(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))
    return nodes.select(node).join(stars.withColumnRenamed("u", node), node, "left").select(node, F.coalesce("component", node).alias("component"))
