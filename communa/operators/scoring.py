"""Quality of partitions under modularity or the constant Potts model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communa.errors import ClusterIndexingError
from communa.operators.network import Network
from communa.operators.partition import Clustering, first_missing
from communa.operators.transforms import clustered_edges

DEFAULT_RESOLUTION = 1.0


def nan_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.when(a == 0, F.lit(float("nan"))).otherwise(a * float("inf")))


def adjusted_resolution_rows(network: Network, resolution: float | None = None) -> DataFrame:
    """One row (adjusted_resolution): resolution over twice the weight of edges and self-links, or resolution itself for CPM."""
    gamma = DEFAULT_RESOLUTION if resolution is None else float(resolution)
    total = 2 * (F.col("total_edge_weight") + F.col("total_self_links_edge_weight"))
    value = nan_divide(F.lit(gamma), total) if network.use_modularity else F.lit(gamma)
    return network.summary().select(value.cast("double").alias("adjusted_resolution"))


def adjusted_resolution(network: Network, resolution: float | None = None) -> float:
    return adjusted_resolution_rows(network, resolution).first()[0]


def quality_rows(network: Network, clustering: Clustering, resolution: float | None = None) -> DataFrame:
    """One row (quality): directed weight inside clusters less resolution times squared cluster weights, over 2m + s. A node without a cluster makes
    the row an error when it is read."""
    inside = clustered_edges(network.adj, clustering.rows).agg(F.coalesce(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight"))), F.lit(0.0)).alias("inside"))
    held = network.nodes.join(clustering.rows, F.col("id") == F.col("node"), "left").groupBy("cluster").agg(F.sum("weight").alias("w"))
    squares = F.sum(F.when(F.col("cluster").isNull(), F.raise_error(F.lit("a node is not in the partition")).cast("double")).otherwise(F.col("w") * F.col("w")))
    weights = held.agg(F.coalesce(squares, F.lit(0.0)).alias("squares"))
    gamma = adjusted_resolution_rows(network, resolution)
    whole = network.summary().select((2 * F.col("total_edge_weight") + F.col("total_self_links_edge_weight")).alias("whole"))
    one = inside.crossJoin(weights).crossJoin(gamma).crossJoin(whole)  # of one row each
    return one.select(nan_divide(F.col("inside") - F.col("adjusted_resolution") * F.col("squares"), F.col("whole")).alias("quality"))


def quality(network: Network, clustering: Clustering, resolution: float | None = None) -> float:
    """The number; a node without a cluster raises ClusterIndexingError."""
    if (node := first_missing(network.nodes, clustering.rows)) is not None:
        raise ClusterIndexingError(f"node {node} is not in the partition")
    return quality_rows(network, clustering, resolution).first()[0]
