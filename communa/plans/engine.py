"""Leiden over DataFrames: parts of the graph that can't influence each other are dealt to tasks, each runs the kernel on its own."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communa.errors import EmptyNetworkError, ParameterRangeError
from communa.operators.components import connected_components
from communa.operators.network import Network
from communa.operators.partition import Clustering, contiguous, sanity_split
from communa.operators.scoring import adjusted_resolution
from communa.plans import kernel
from communa.plans.supersteps import bin_of, by_least_node, connected_pieces, shrunk, unrolled
from communa.storage import drop, materialize, sized

#: Adjacency rows of one task's graph: larger components go through supersteps first, smaller ones share a task up to BIN_ROWS.
KERNEL_ROWS, BIN_ROWS = 5_000_000, 1_500_000


def checked(network: Network, resolution: float | None, randomness: float, trials: int) -> float:
    """The adjusted resolution, once parameters and then the network have passed."""
    gamma = adjusted_resolution(network, resolution)
    if trials < 1:
        raise ParameterRangeError("trials is 1 or more")
    empty = network.nodes.limit(1).count() == 0
    if randomness <= 0 or (gamma <= 0 if not np.isnan(gamma) else not empty):
        raise ParameterRangeError("randomness and the resolution, adjusted to the network's weight, are above 0")
    if empty:
        raise EmptyNetworkError("the network has no nodes")
    return gamma


def solve(nodes: DataFrame, adj: DataFrame, gamma: DataFrame | float, randomness: float, iterations: int, use_modularity: bool, seed: int, trials: int) -> DataFrame:
    """nodes (bin, grp, id, weight, cluster), adj (bin, src, dst, weight) -> (trial, grp, node, cluster, moved): the kernel on each bin, whose groups share no
    edge, no cluster and no node, so they are solved as one graph; nodes carry ``gamma`` if that is None. Clusters are named by their least node; moved is
    of the bin. A task holds one bin at a time."""
    turns, again = (nodes.sparkSession.range(trials).withColumnRenamed("id", "trial") for _ in range(2))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trial = key[0].as_py()
        ids = left.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        weight, start, gam = (left.column(c).to_numpy()[order] for c in ("weight", "cluster", "gamma"))
        src, dst = (np.searchsorted(ids, right.column(c).to_numpy()) for c in ("src", "dst"))
        g = kernel.Graph.of(len(ids), src, dst, right.column("weight").to_numpy(), weight)
        del src, dst
        rng = np.random.default_rng([seed & 0xFFFFFFFF, trial, int(ids[0])] if len(ids) else seed & 0xFFFFFFFF)
        cluster, improved = kernel.leiden(g, start, gam, randomness, iterations, use_modularity, rng)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, cluster, ids)
        return pa.table({"trial": np.full(len(ids), trial), "grp": left.column("grp").to_numpy()[order], "node": ids, "cluster": least[cluster], "moved": np.full(len(ids), improved)})

    schema = "trial long, grp long, node long, cluster long, moved boolean"
    named = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  new columns, for sides of one origin
    left = nodes.select(*named("bin", "grp", "id", "weight", "cluster"), F.lit(gamma).cast("double").alias("gamma") if gamma is not None else F.col("gamma").alias("gamma"))
    left, right = left.crossJoin(F.broadcast(turns)), adj.select(*named("bin", "src", "dst", "weight")).crossJoin(F.broadcast(again))  # trials, a parameter, times the rows
    return left.groupBy("trial", "bin").cogroup(right.groupBy("trial", "bin")).applyInArrow(run, schema)


def binned(nodes: DataFrame, adj: DataFrame, rows: DataFrame | None, bin_rows: int, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and adj with grp and bin: components of edges and shared clusters, ``parts`` (id, component, n) where they are known, never influence each other, so each
    stays whole. A graph within bin_rows is one group. Without rows (node, cluster) every node is alone."""
    alone = nodes.select("id", "weight", F.col("id").alias("cluster"))
    held = alone if rows is None else nodes.join(rows, F.col("id") == F.col("node")).select("id", "weight", "cluster")
    count = adj.count()
    if count <= bin_rows:
        return held.withColumn("grp", F.lit(0).cast("long")).withColumn("bin", F.lit(0).cast("long")), adj.withColumn("bin", F.lit(0).cast("long"))
    parts = sized_parts(nodes, adj, rows) if parts is None else parts
    placed = parts.select("id", F.col("component").alias("grp"), bin_of("component", F.col("n"), count, bin_rows).alias("bin"))
    return held.join(placed, "id"), adj.join(placed.select(F.col("id").alias("src"), "bin"), "src")


def bound_parts(nodes: DataFrame, adj: DataFrame, rows: DataFrame | None) -> DataFrame:
    """(id, component): components of edges and shared clusters, between which no move can go."""
    links = adj.filter("src < dst").select("src", "dst")
    if rows is not None:
        hubs = rows.groupBy("cluster").agg(F.min("node").alias("dst"))
        links = links.union(rows.join(hubs, "cluster").select(F.col("node").alias("src"), "dst"))
    return connected_components(nodes.select("id"), links)


def sized_parts(nodes: DataFrame, adj: DataFrame, rows: DataFrame | None) -> DataFrame:
    """(id, component, n), written: :func:`bound_parts` with the adjacency rows of each."""
    parts = materialize(bound_parts(nodes, adj, rows))
    degrees = adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    sizes = parts.join(degrees, "id").groupBy("component").agg(F.sum("n").alias("n"))
    sized = materialize(parts.join(sizes, "component", "left").select("id", "component", F.coalesce("n", F.lit(0)).alias("n")))
    drop(parts)
    return sized


def oversized(parts: DataFrame, kernel_rows: int) -> DataFrame | None:
    """(node, grp), written, of the components in parts (id, component, n) of more than kernel_rows adjacency rows, if there are any."""
    large = parts.filter(F.col("n") > kernel_rows)
    return materialize(large.select(F.col("id").alias("node"), F.col("component").alias("grp"))) if large.limit(1).count() else None


def within(network: Network, nodes: DataFrame, how: str = "left_semi") -> Network:
    """The nodes in nodes (node), or with left_anti the others, and their edges, written; no edge joins the one with the other."""
    some = nodes.select("node")
    held = network.nodes.join(some.withColumnRenamed("node", "id"), "id", how).select("id", "label", "weight")
    adj = network.adj.join(some.withColumnRenamed("node", "src"), "src", how).select("src", "dst", "weight")
    return Network(materialize(held), materialize(adj), None, network.use_modularity, 0.0)


def solve_large(
    network: Network, owner: DataFrame, rows: DataFrame | None, gamma: float, randomness: float, iterations: int, seed: int, trials: int, kernel_rows: int, bin_rows: int, gammas: DataFrame | None = None,
) -> DataFrame:
    """(trial, grp, node, cluster), written, of groups, owner (node, grp), that share no edge and are too large for a task: they are shrunk side by side by
    supersteps until each fits one, solved by the kernel, projected back and moved on level by level. A trial is a copy of the network with random numbers
    of its own, so all of them go through the same steps. A group that no contraction makes small enough goes to no task: it stays as its nodes were moved.

    With ``gammas`` (grp, gamma) the network's weights are the nodes' own times the roots of these, for a gamma of 1."""
    shift = network.nodes.agg(F.max("id") + 1).first()[0]
    if trials > 1:
        turn = network.nodes.sparkSession.range(trials).select((F.col("id") * shift).alias("_by"))
        copied = lambda df, *ids: df.crossJoin(F.broadcast(turn)).select(*[(F.col(c) + F.col("_by")).alias(c) if c in ids else F.col(c) for c in df.columns])  # noqa: E731  trials, a parameter, times the rows
        network = Network(materialize(copied(network.nodes, "id")), materialize(copied(network.adj, "src", "dst")), None, network.use_modularity, 0.0)
        owner = materialize(copied(owner, "node", "grp"))
        rows = None if rows is None else copied(rows.select("node", "cluster"), "node", "cluster")
    levels, unfit = shrunk(network, owner, gamma, seed, kernel_rows, rows, randomness)
    last = levels[-1]
    fits = last.owner.join(unfit, "grp", "left_anti").select("node", "grp")
    nodes = last.network.nodes.join(fits, F.col("id") == F.col("node")).join(last.rows, "node").select("grp", "id", "weight", "cluster")
    nodes = nodes.withColumn("gamma", F.lit(gamma).cast("double")) if gammas is None else nodes.join(gammas, "grp").withColumn("weight", F.col("weight") / F.sqrt("gamma"))
    adj = last.network.adj.join(fits.withColumnRenamed("node", "src"), "src")
    sizes = adj.groupBy("grp").agg(F.count("*").alias("n"))
    total = adj.count()
    placed = materialize(fits.select("grp").distinct().join(sizes, "grp", "left").select("grp", bin_of("grp", F.col("n"), total, bin_rows).alias("bin")))
    found = solve(nodes.join(placed, "grp"), adj.join(placed, "grp"), None, randomness, iterations, network.use_modularity, seed, 1).select("node", "cluster")
    left = last.rows.join(last.owner.join(unfit, "grp", "left_semi").select("node"), "node", "left_semi").select("node", -1 - F.col("cluster").alias("cluster"))
    moved = unrolled(levels, materialize(by_least_node(found.union(left))), gamma, seed, kernel_rows)
    pieces = materialize(connected_pieces(network, moved))
    trial = F.expr(f"node div {shift}") if trials > 1 else F.lit(0).cast("long")
    own = lambda c: (F.col(c) - trial * shift).alias(c)
    return materialize(pieces.join(owner, "node").select(trial.alias("trial"), own("grp"), own("node"), own("cluster")))


def trial_scores(network: Network, rows: DataFrame, gamma: float) -> DataFrame:
    """(trial, score) of rows (trial, node, cluster): quality up to a factor that all trials share."""
    a = rows.select("trial", F.col("node").alias("src"), F.col("cluster").alias("c1"))
    b = rows.select(F.col("trial").alias("t2"), F.col("node").alias("dst"), F.col("cluster").alias("c2"))
    pairs = network.adj.join(a, "src").join(b, "dst").filter("trial = t2 and c1 = c2")
    inside = pairs.groupBy("trial").agg(F.sum("weight").alias("inside"))
    squares = rows.join(network.nodes, F.col("node") == F.col("id")).groupBy("trial", "cluster").agg(F.sum("weight").alias("w")).groupBy("trial").agg(F.sum(F.col("w") * F.col("w")).alias("squares"))
    return squares.join(inside, "trial", "left").select("trial", (F.coalesce("inside", F.lit(0.0)) - gamma * F.col("squares")).alias("score"))


@sized
def leiden_clustering(
    network: Network, clustering: Clustering | None = None, resolution: float | None = 1.0, randomness: float = 0.001, iterations: int = 1, seed: int | None = None, trials: int = 1,
    kernel_rows: int = KERNEL_ROWS, bin_rows: int = BIN_ROWS,
) -> tuple[bool, Clustering]:
    """(whether anything moved, partition of best quality over the trials), its clusters numbered from 0 by their least node.

    Without a partition to start from, every node is alone. The same network, parameters and seed give the same result, however it is
    partitioned. Components of more than ``kernel_rows`` adjacency rows go through supersteps, from single nodes or the clusters to start from, until
    a task holds what they are contracted to, and back to the nodes."""
    gamma = checked(network, resolution, randomness, trials)
    seed = random.SystemRandom().getrandbits(31) if seed is None else seed
    start = None if clustering is None else materialize(sanity_split(network.adj, clustering).rows)
    parts = sized_parts(network.nodes, network.adj, start) if network.adj.count() > min(kernel_rows, bin_rows) else None
    owner, rest = None if parts is None else oversized(parts, kernel_rows), network
    found, improved = None, False
    if owner is not None:
        before = Clustering.self_clusters(network.nodes).rows if start is None else start
        rest, begun = within(network, owner, "left_anti"), materialize(before.join(owner, "node", "left_semi").select("node", "cluster"))
        found = solve_large(within(network, owner), owner, None if clustering is None else begun, gamma, randomness, iterations, seed, trials, kernel_rows, bin_rows).select("trial", "node", "cluster")
        start = None if start is None else start.join(owner, "node", "left_anti").select("node", "cluster")
    if owner is None or rest.nodes.limit(1).count():
        nodes, adj = binned(rest.nodes, rest.adj, start, bin_rows, parts)
        small = materialize(solve(nodes, adj, gamma, randomness, iterations, network.use_modularity, seed, trials))
        improved = bool(small.agg(F.max("moved")).first()[0])
        found = small.select("trial", "node", "cluster") if found is None else found.union(small.select("trial", "node", "cluster"))
    if trials > 1:
        best = trial_scores(network, found, gamma).orderBy(F.desc("score"), "trial").first()["trial"]
        found = found.filter(F.col("trial") == best)
    rows = found.select("node", "cluster")
    if owner is not None and not improved:
        before, after = by_least_node(begun), by_least_node(rows).select("node", F.col("cluster").alias("now"))
        improved = before.join(after, "node").filter("cluster <> now").limit(1).count() > 0
    return improved, Clustering(materialize(contiguous(rows, named=True)))
