"""Subnetworks of a partition's clusters, and the quotient network between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communa.errors import UnsafeInducementError
from communa.operators.network import Network
from communa.operators.partition import Clustering, first_missing


def clustered_edges(adj: DataFrame, rows: DataFrame) -> DataFrame:
    """adj with the clusters c1, c2 of both ends."""
    a, b = rows.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), rows.select(F.col("node").alias("dst"), F.col("cluster").alias("c2"))
    return adj.join(a, "src").join(b, "dst")


def subnetworks(adj: DataFrame, clustering: Clustering, min_size: int | None = None) -> DataFrame:
    """(cluster, src, dst, weight): the edges inside clusters; with ``min_size`` of clusters of that many nodes or more, picked first."""
    rows = clustering.rows
    if min_size is not None:
        large = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("cluster")
        rows = rows.join(large, "cluster", "left_semi").select("node", "cluster")
    return clustered_edges(adj, rows).filter("c1 = c2").select(F.col("c1").alias("cluster"), "src", "dst", "weight")


def subnetwork_nodes(edges: DataFrame, use_modularity: bool = True) -> DataFrame:
    """(cluster, id, weight): nodes with edges inside their cluster, weighted by those edges, or 1."""
    weight = F.sum("weight") if use_modularity else F.lit(1.0)
    return edges.groupBy("cluster", F.col("src").alias("id")).agg(weight.alias("weight"))


def induced_network(network: Network, clustering: Clustering) -> Network:
    """Clusters as nodes, weighted by their nodes; edges summed between them; self-links grow by the directed weight inside clusters.
    Ids below next_cluster_id without nodes stay, with weight 0. A partition that leaves nodes out raises UnsafeInducementError."""
    rows = clustering.rows
    if (node := first_missing(network.nodes, rows)) is not None:
        raise UnsafeInducementError(f"node {node} is not in the partition")
    sums = clustered_edges(network.adj, rows).groupBy(F.col("c1").alias("src"), F.col("c2").alias("dst")).agg(F.sum("weight").alias("weight"))
    held = network.nodes.join(rows, network.nodes["id"] == rows["node"]).groupBy("cluster").agg(F.sum("weight").alias("weight"))
    ids = rows.sparkSession.range(clustering.next_cluster_id())
    nodes = ids.join(held, ids["id"] == held["cluster"], "left").select("id", F.col("id").cast("string").alias("label"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    inner = sums.filter("src = dst").select("src", "weight")
    before = network.self_links().select(F.lit(-1).cast("long").alias("src"), F.col("total_self_links_edge_weight").alias("weight"))
    return Network(nodes, sums.filter("src <> dst"), inner.union(before), network.use_modularity)
