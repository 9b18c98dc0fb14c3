"""Partitions of a network's nodes: (node BIGINT, cluster BIGINT) and their algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.errors import ClusterIndexingError, InvalidCommunityMappingError
from communa.operators.ordering import number_rows
from communa.storage import materialize

SCHEMA = "node long, cluster long"
#: Nodes that :meth:`Clustering.members` and :meth:`Clustering.as_map` put into one row at most.
ROW_NODES = 50_000_000


def first_missing(nodes: DataFrame, rows: DataFrame) -> int | None:
    """A node of nodes(id) that rows(node, cluster) leave out."""
    found = nodes.select("id").join(rows.select(F.col("node").alias("id")), "id", "left_anti").first()
    return None if found is None else found["id"]


@dataclass
class Clustering:
    """rows(node, cluster); ``next_id`` may exceed the clusters in use, and is found from the rows where it isn't given."""

    rows: DataFrame
    next_id: int | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Clustering:
        return cls(spark.createDataFrame([], SCHEMA), 0)

    @classmethod
    def self_clusters(cls, nodes: DataFrame) -> Clustering:
        """Every node of nodes(id) alone, in the cluster of its own number."""
        return cls(nodes.select(F.col("id").alias("node"), F.col("id").alias("cluster")))

    @classmethod
    def defined(cls, rows: DataFrame, next_id: int | None = None) -> Clustering:
        return cls(rows.select(F.col("node").cast("long"), F.col("cluster").cast("long")), next_id)

    def next_cluster_id(self) -> int:
        if self.next_id is None:
            self.next_id = self.rows.agg(F.coalesce(F.max("cluster") + 1, F.lit(0)).cast("long").alias("n")).first()["n"]
        return self.next_id

    def reset_next_cluster_id(self) -> Clustering:
        return Clustering(self.rows, 0)

    def num_nodes(self) -> int:
        return self.rows.count()

    def cluster_at(self, node: int) -> int:
        found = self.rows.filter(F.col("node") == node).first()
        if found is None:
            raise ClusterIndexingError(f"node {node} is not in the partition")
        return found["cluster"]

    def update(self, changes: DataFrame) -> Clustering:
        """Clusters of (node, cluster) rows take the place of the old ones; nodes not in the partition are ignored."""
        new = changes.select("node", F.col("cluster").alias("_new"))
        rows = self.rows.join(new, "node", "left").select("node", F.coalesce("_new", "cluster").alias("cluster"))
        return Clustering(rows)

    def sizes(self) -> DataFrame:
        """(cluster, n) for all ids below next_cluster_id, 0 for empty ones."""
        ids = self.rows.sparkSession.range(self.next_cluster_id()).withColumnRenamed("id", "cluster")
        counts = self.rows.groupBy("cluster").agg(F.count("*").alias("n"))
        return ids.join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def members(self) -> DataFrame:
        """(cluster, members) with members in rising order, a row for each cluster; one of more than ROW_NODES nodes raises."""
        if large := self.rows.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > ROW_NODES).first():
            raise ValueError(f"cluster {large['cluster']} has {large['n']} nodes, more than a row takes")
        return self.rows.groupBy("cluster").agg(F.array_sort(F.collect_list("node")).alias("members"))

    def compacted(self) -> Clustering:
        """The clusters in use renumbered from 0 in their order."""
        used = number_rows(self.rows.select("cluster").distinct(), "cluster", name="_new")
        return Clustering(self.rows.join(used, "cluster").select("node", F.col("_new").alias("cluster")))

    def composed(self, other: Clustering) -> Clustering:
        """Each node in the cluster that its cluster has in ``other``; a cluster that ``other`` doesn't have raises."""
        if (cluster := first_missing(self.rows.select(F.col("cluster").alias("id")).distinct(), other.rows)) is not None:
            raise ClusterIndexingError(f"cluster {cluster} is not in the outer partition")
        outer = other.rows.select(F.col("node").alias("cluster"), F.col("cluster").alias("_outer"))
        return Clustering(self.rows.join(outer, "cluster").select("node", F.col("_outer").alias("cluster")), other.next_id)

    def refined(self, parts: DataFrame) -> Clustering:
        """Clusters split by (node, part): each (cluster, part) gets a number, in that order, from 0."""
        pairs = self.rows.join(parts, "node")
        numbers = number_rows(pairs.select("cluster", "part").distinct(), "cluster", "part", name="_new")
        return Clustering(pairs.join(numbers, ["cluster", "part"]).select("node", F.col("_new").alias("cluster")))

    def as_map(self) -> DataFrame:
        """One row with a map from node to cluster; a partition of more than ROW_NODES nodes raises."""
        if (n := self.rows.count()) > ROW_NODES:
            raise ValueError(f"the partition has {n} nodes, more than a row takes")
        return self.rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "cluster")))).alias("clusters"))

    def ordered(self) -> DataFrame:
        return self.rows.orderBy("cluster", "node")


def induced_initial(counts: DataFrame) -> Clustering:
    """(cluster, parts) -> the partition of the parts, numbered cluster by cluster from 0, by cluster."""
    numbered = counts.select("cluster", F.explode(F.sequence(F.lit(1), F.col("parts").cast("int"))).alias("part"), "parts").filter("parts > 0")
    return Clustering(number_rows(numbered.select("cluster", "part"), "cluster", "part", name="node").select("node", "cluster"))


def sanity_split(adj: DataFrame, clustering: Clustering) -> Clustering:
    """Nodes that share their cluster but no edge with any of it get clusters of their own, numbered on from next_cluster_id by node."""
    rows = clustering.rows
    shared = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    a, b = rows.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), rows.select(F.col("node").alias("dst"), F.col("cluster").alias("c2"))
    linked = adj.join(a, "src").join(b, "dst").filter("c1 = c2").select(F.col("src").alias("node")).distinct()
    stray = rows.join(shared, "cluster", "left_semi").join(linked, "node", "left_anti").select("node")
    moved = number_rows(stray, "node", name="_k").select("node", (F.col("_k") + clustering.next_cluster_id()).alias("cluster"))
    return clustering.update(moved)


def checked_communities(communities: DataFrame) -> DataFrame:
    """(node label, cluster, ...), each label once; raises InvalidCommunityMappingError as :func:`starting_communities` says."""
    number = F.col("cluster").cast("long")
    once = communities.groupBy("node").agg(F.min(number).alias("cluster"), F.max(number).alias("most"), F.count(F.when(number.isNull(), 1)).alias("nulls"))
    if wrong := once.filter("cluster <> most or cluster < 0 or nulls > 0").first():
        raise InvalidCommunityMappingError(f"{wrong['node']!r} is in cluster {wrong['cluster']}, and in {wrong['most']}" if wrong["cluster"] != wrong["most"] else f"{wrong['node']!r} is in cluster {wrong['cluster']}")
    return once


def starting_communities(nodes: DataFrame, communities: DataFrame) -> Clustering:
    """nodes(id, label) and communities(node label, cluster) -> partition: nodes without a community are alone, labels that the network
    doesn't have are ignored, and clusters are renumbered from 0 in their order. Rows that repeat count once; a label in two clusters, a
    null cluster and one below 0 raise InvalidCommunityMappingError."""
    communities = checked_communities(communities)
    given = communities.select(F.col("node").alias("label"), F.col("cluster").cast("long").alias("_given"))
    top = communities.agg(F.coalesce(F.max("cluster") + 1, F.lit(0)).cast("long").alias("_top"))
    rows = nodes.select("id", "label").join(given, "label", "left").crossJoin(F.broadcast(top))  # of one row
    return Clustering(rows.select(F.col("id").alias("node"), F.coalesce("_given", F.col("_top") + F.col("id")).alias("cluster"))).compacted()


def contiguous(rows: DataFrame, named: bool = False) -> DataFrame:
    """(node, cluster) with clusters renumbered from 0 by their least node; ``named`` says that they are named by it, so no grouping is needed to find it."""
    least = rows.filter("node = cluster").select("cluster", F.col("node").alias("_least")) if named else rows.groupBy("cluster").agg(F.min("node").alias("_least"))
    return rows.join(number_rows(least, "_least", name="_new"), "cluster").select("node", F.col("_new").alias("cluster"))


def dense_ranks(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with ``rank`` from 0 within each group: the row's number in the whole less that of the group's first, so a large group is no task of its own."""
    numbered = materialize(number_rows(rows, group, *order, name="_n"))
    first = numbered.groupBy(group).agg(F.min("_n").alias("_first"))
    return numbered.join(first, group).select(*rows.columns, (F.col("_n") - F.col("_first")).alias("rank"))
