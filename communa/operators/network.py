"""Networks: undirected weighted graphs as two DataFrames, built from edge lists, and their scans, lookups and totals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communa.errors import InternalNetworkIndexingError
from communa.operators.ordering import number_rows
from communa.storage import drop, materialize


def symmetrized(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) with each row in both directions."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("e"), "weight").select("e.src", "e.dst", "weight")


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``ord``, their place in the input; without that column the order is by src, dst, weight."""
    return edges if "ord" in edges.columns else number_rows(edges, "src", "dst", "weight", name="ord")


def dictionary(edges: DataFrame) -> DataFrame:
    """(id, label): labels numbered from 0 as first seen over source and target of the edges in order of ``ord``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("label"), (2 * F.col("ord")).alias("pos")), F.struct(F.col("dst").alias("label"), (2 * F.col("ord") + 1).alias("pos")))).alias("e"))
    return number_rows(ends.groupBy("e.label").agg(F.min("e.pos").alias("pos")), "pos").select("id", "label")


def deduplicated(edges: DataFrame, dedupe: str = "first") -> DataFrame:
    """One (src, dst, weight) for each unordered pair, src <= dst: the first weight by ``ord``, or the sum."""
    if dedupe not in ("first", "sum"):
        raise ValueError("dedupe is 'first' or 'sum'")
    weight = F.min_by("weight", "ord") if dedupe == "first" else F.sum("weight")
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(weight.alias("weight"))


def encoded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ids for labels."""
    s, d = nodes.select(F.col("id").alias("s"), F.col("label").alias("src")), nodes.select(F.col("id").alias("d"), F.col("label").alias("dst"))
    return edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight", "ord")


@dataclass
class Network:
    """nodes(id, label, weight) and adj(src, dst, weight), which holds each edge twice and no loops; self_links sums the loops."""

    nodes: DataFrame
    adj: DataFrame
    loops: DataFrame | None = None
    use_modularity: bool = True
    _self_links: float | None = field(default=None, repr=False)
    #: What nodes, adj and loops were derived from: (id, label) and (src, dst, weight), each pair once.
    _origin: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, use_modularity: bool = True, dedupe: str = "first") -> Network:
        """From (src STRING, dst STRING, weight DOUBLE[, ord]). A pair's first weight counts, whatever its direction; loops are taken out."""
        edges = ordered_edges(edges)
        labels = dictionary(edges)
        pairs = deduplicated(encoded(edges, labels), dedupe)
        return cls._of(labels, pairs, use_modularity)

    @classmethod
    def _of(cls, labels: DataFrame, pairs: DataFrame, use_modularity: bool) -> Network:
        adj = symmetrized(pairs.filter("src <> dst"))
        loops = pairs.filter("src = dst").select("src", "weight")
        return cls(cls.weighted(labels, adj, use_modularity), adj, loops, use_modularity, _origin=(labels, pairs))

    @staticmethod
    def weighted(labels: DataFrame, adj: DataFrame, use_modularity: bool) -> DataFrame:
        """Node weights: the sum of the edges at a node, or 1."""
        if not use_modularity:
            return labels.withColumn("weight", F.lit(1.0))
        strength = adj.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("weight"))
        return labels.join(strength, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))

    @cached_property
    def totals(self) -> dict:
        """num_nodes, num_edges, total_node_weight, total_edge_weight, total_self_links_edge_weight in one job."""
        return self.summary().first().asDict()

    def summary(self) -> DataFrame:
        """One row with the totals."""
        nodes = self.nodes.agg(F.count("*").alias("num_nodes"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_node_weight"))
        adj = self.adj.agg(F.expr("count(*) div 2").alias("num_edges"), (F.coalesce(F.sum("weight"), F.lit(0.0)) / 2).alias("total_edge_weight"))
        return nodes.crossJoin(adj).crossJoin(self.self_links()).select("num_nodes", "num_edges", "total_node_weight", "total_edge_weight", "total_self_links_edge_weight")  # of one row each

    def self_links(self) -> DataFrame:
        """One row: total_self_links_edge_weight."""
        name = "total_self_links_edge_weight"
        if self.loops is None:
            return self.nodes.sparkSession.range(1).select(F.lit(float(self._self_links or 0.0)).alias(name))
        return self.loops.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias(name))

    def kept(self) -> Network:
        """Nodes, adjacency and loops as written tables, for the many passes of an optimisation: a lost executor costs none of them."""
        if self._origin is not None:  # the joins and the grouping behind all three are run once
            labels, pairs = self._origin
            self._origin = None
            pairs = materialize(pairs)
            fresh = Network._of(labels, pairs, self.use_modularity)
            self.adj = materialize(fresh.adj)
            self.nodes = materialize(self.weighted(labels, self.adj, self.use_modularity))
            self.loops = materialize(fresh.loops)
            drop(pairs)
            return self
        self.adj = materialize(self.adj)
        self.nodes = materialize(self.nodes)
        self.loops = None if self.loops is None else materialize(self.loops)
        return self

    def sorted_adjacency(self) -> DataFrame:
        """adj dealt by src and sorted by (src, dst) in each partition."""
        return self.adj.repartition("src").sortWithinPartitions("src", "dst")

    def neighbor_ranges(self) -> DataFrame:
        """(id, first, degree): where a node's neighbours begin in the adjacency sorted by (src, dst), and how many there are."""
        degree = self.nodes.select("id").join(self.adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
        return running_total(degree, "id", "degree", "first").select("id", "first", "degree")

    def neighbor_scan(self) -> DataFrame:
        """(src, connection_id, id, edge_weight, node_weight): the adjacency in order, numbered, with the neighbour's node weight."""
        rows = number_rows(self.adj.select("src", "dst", "weight"), "src", "dst", name="connection_id")
        ends = self.nodes.select(F.col("id").alias("dst"), F.col("weight").alias("node_weight"))
        return rows.join(ends, "dst").select("src", "connection_id", F.col("dst").alias("id"), F.col("weight").alias("edge_weight"), "node_weight")

    def neighbors_for(self, node: int) -> DataFrame:
        return self.adj.filter(F.col("src") == node).select(F.col("dst").alias("id"), "weight")

    def strengths(self) -> DataFrame:
        """(id, strength): sum of the edges at each node."""
        strength = self.adj.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"))
        return self.nodes.select("id").join(strength, "id", "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def node_weight(self, node: int) -> float:
        found = self.nodes.filter(F.col("id") == node).select("weight").first()
        if found is None:
            raise InternalNetworkIndexingError(f"no node {node}")
        return found["weight"]

    def ids_for(self, labels: DataFrame, column: str = "label") -> DataFrame:
        """labels with their ``id``; null for those that the network doesn't have."""
        return labels.join(self.nodes.select(F.col("label").alias(column), "id"), column, "left")

    def labels_for(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """ids with their ``label``; null for those that the network doesn't have."""
        return ids.join(self.nodes.select(F.col("id").alias(column), "label"), column, "left")

    def edge_weight(self, a: str, b: str) -> float | None:
        """Weight of the edge between two labels."""
        name = self.nodes.select("id", "label")
        ends = self.adj.join(name.filter(F.col("label") == a).select(F.col("id").alias("src")), "src").join(name.filter(F.col("label") == b).select(F.col("id").alias("dst")), "dst").first()
        return ends["weight"] if ends else None


def running_total(df: DataFrame, order: str, value: str, name: str, block: Column | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before, by ``order``, a dense number from 0. Blocks of numbers are summed first, so no task
    sees more than a block of rows or one row a block."""
    block = F.expr(f"{order} div 4096") if block is None else block
    rows = df.withColumn("_block", block)
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    ahead = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(ahead, "_block").withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_block", "_inside", "_ahead")
