"""The steps of local moving and refinement, each for all nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communa.functions.gains import approximate_exponent, quality_increment, well_connected


def cluster_weights(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(cluster, weight, n) of nodes(id, weight) under rows(node, cluster)."""
    return nodes.join(rows, F.col("id") == F.col("node")).groupBy("cluster").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def neighbor_clusters(adj: DataFrame, rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(node, cluster, weight): weight of each node's edges into each cluster that a neighbour is in; its own is there even at 0. With ``asked``, some of
    the rows, for their nodes alone."""
    own = rows if asked is None else asked
    some = adj if asked is None else adj.join(asked.select(F.col("node").alias("src")), "src", "left_semi")
    ends = rows.select(F.col("node").alias("dst"), "cluster")
    near = some.join(ends, "dst").select(F.col("src").alias("node"), "cluster", "weight")
    return near.union(own.select("node", "cluster", F.lit(0.0))).groupBy("node", "cluster").agg(F.sum("weight").alias("weight"))


def move_gains(nodes: DataFrame, adj: DataFrame, rows: DataFrame, gamma: float, empty: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(node, cluster, gain, stay, empty, own): gain of each cluster a node could join, the node taken out of its own first, and of an
    empty cluster: its number is ``empty`` (by default -1 - node, free for every node) and its gain 0; own is the node's weight. With ``asked``, some of the rows,
    for their nodes alone."""
    weights = cluster_weights(nodes, rows).select("cluster", F.col("weight").alias("held"))
    own = nodes.join(rows if asked is None else asked, F.col("id") == F.col("node")).select("node", F.col("weight").alias("own"), F.col("cluster").alias("at"))
    near = neighbor_clusters(adj, rows, asked).join(own, "node").join(weights, "cluster")
    stay = F.col("cluster") == F.col("at")
    held = F.col("held") - F.when(stay, F.col("own")).otherwise(F.lit(0.0))
    gains = near.select("node", "cluster", quality_increment(F.col("weight"), F.col("own"), held, F.lit(gamma)).alias("gain"), stay.alias("stay"), F.lit(False).alias("empty"), "own")
    free = F.lit(empty).cast("long") if empty is not None else -1 - F.col("node")
    return gains.union(own.select("node", free.alias("cluster"), F.lit(0.0), F.lit(False), F.lit(True), "own"))


def best_moves(gains: DataFrame) -> DataFrame:
    """(node, cluster, gain, stay, empty, own, at, here): the best cluster of each node; ties go to staying, then the empty one, then the least number. at
    and here are its own cluster and the gain of staying."""
    key = F.struct("gain", "stay", "empty", (-F.col("cluster")).alias("low"))
    stays = [F.max(F.when(F.col("stay"), F.col(c))).alias(n) for c, n in (("cluster", "at"), ("gain", "here"))]
    return gains.groupBy("node").agg(F.max_by(F.struct("cluster", "gain", "stay", "empty", "own"), key).alias("b"), *stays).select("node", "b.*", "at", "here")


def requeued(adj: DataFrame, rows: DataFrame, moved: DataFrame) -> DataFrame:
    """(node): neighbours of moved nodes (node, cluster) that are not in the cluster these moved to."""
    near = adj.join(moved.select(F.col("node").alias("src"), F.col("cluster").alias("to")), "src").select(F.col("dst").alias("node"), "to")
    return near.join(rows, "node").filter(F.col("cluster") != F.col("to")).select("node").distinct()


def cut_weights(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(cluster, part, cut): weight of edges from each part of a cluster to the rest of it; edges are (cluster, src, dst, weight),
    parts (node, part)."""
    a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("p1")), parts.select(F.col("node").alias("dst"), F.col("part").alias("p2"))
    cut = F.sum(F.when(F.col("p1") != F.col("p2"), F.col("weight")).otherwise(F.lit(0.0)))
    return edges.join(a, "src").join(b, "dst").groupBy("cluster", F.col("p1").alias("part")).agg(cut.alias("cut"))


def connected_well(edges: DataFrame, nodes: DataFrame, parts: DataFrame, gamma: float) -> DataFrame:
    """(cluster, part, well): whether each part of a cluster is well connected to the rest; nodes are (cluster, id, weight)."""
    held = nodes.join(parts, F.col("id") == F.col("node")).groupBy("cluster", "part").agg(F.sum("weight").alias("held"))
    total = nodes.groupBy("cluster").agg(F.sum("weight").alias("total"))
    found = cut_weights(edges, parts).join(held, ["cluster", "part"]).join(total, "cluster")
    return found.select("cluster", "part", well_connected(F.col("cut"), F.col("held"), F.col("total"), F.lit(gamma)).alias("well"))


def softmax_choices(candidates: DataFrame, randomness: float, draw: str) -> DataFrame:
    """(node, cluster, gain, <draw>) -> (node, cluster): a cluster of gain 0 or more for each node, with chances in proportion to the
    approximate exponent of gain over randomness, by a number in [0, 1); the best where these weights overflow."""
    weight = approximate_exponent(F.col("gain") / randomness)
    by = Window.partitionBy("node").orderBy("cluster")
    rows = candidates.filter("gain >= 0").withColumn("w", weight)
    rows = rows.withColumn("upto", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(Window.partitionBy("node")))
    finite = F.col("total") < float("inf")
    hit = F.when(finite, F.when(F.col("upto") >= F.col(draw) * F.col("total"), F.struct(F.lit(0.0).alias("a"), F.col("cluster").alias("b")))).otherwise(F.struct((-F.col("gain")).alias("a"), F.col("cluster").alias("b")))
    return rows.withColumn("hit", hit).groupBy("node").agg(F.min_by("cluster", "hit").alias("cluster"))
