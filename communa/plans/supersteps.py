"""Leiden on networks too large for one task: local moving, refinement and contraction as DataFrame steps, down to what a task holds and up again.

In a step the clusters are dealt to parts by chance, anew each time, few enough of them that a task holds a part's edges. A task moves the nodes of its part one after the other
between the part's clusters, as the kernel does. All nodes of those clusters are there, so its gains are exact, and they add up, as parts share no cluster.

Nodes of a part that no task holds, one with a very large cluster, move many at once. They are put in a random order, and a move counts only if it gains in that order even
against the worst that the moves before it may do: neighbours that leave its target or join its old cluster, weight that comes to the one and goes from the other. So the quality never
falls, whatever of them is dropped.

Clusters that a task holds are refined in one, whole; larger ones in rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communa.functions.gains import log_exponent, seeded_uniform, well_connected
from communa.operators.components import connected_components
from communa.operators.moves import best_moves, move_gains, requeued
from communa.operators.network import Network
from communa.operators.partition import Clustering
from communa.operators.transforms import clustered_edges
from communa.plans import kernel
from communa.storage import drop, materialize

#: Steps of local moving on the way down and on the way up, and the share of the first of all steps' gain below which they end, so many in a row where clusters are dealt.
STEPS, STEPS_UP, LEAST_GAIN, QUIET = 16, 8, 1e-2, 2
#: That share on the way down where clusters are dealt: what is left to gain then is left to the next level, whose nodes are parts, and to the way up, which ends by LEAST_GAIN.
LEAST_DOWN = 5e-2
#: Rounds of refinement, and the share of parts that a round merges at least for another to follow.
ROUNDS, LEAST_MERGED = 6, 0.05
#: Levels at most, and the share of adjacency rows that a level loses at least.
DEPTH, LEAST_SHRUNK = 30, 0.05
#: Turns for each halving of the order: the weight that goes before a move is known to about a tenth.
FINE = 8
#: Bins of small groups that the rows of a bin are cut into.
SHARE = 8


def bin_of(group: str, rows: Column, total: int, bin_rows: int) -> Column:
    """The bin of a group of so many adjacency rows: its own if that is over half of ``bin_rows``, else one of about a SHARE-th of ``bin_rows``, so that a task's
    memory follows neither the number of groups nor that of bins in a task."""
    shared = -1 - F.pmod(F.xxhash64(group), F.lit(max(1, -(-total * SHARE // bin_rows))))
    return F.when(F.coalesce(rows, F.lit(0)) * 2 > bin_rows, F.col(group)).otherwise(shared).cast("long")


def _turn(order: Column) -> Column:
    """The place of a number in (0, 1) on a logarithmic scale; the larger is the earlier."""
    return F.least(F.floor(-F.log2(order + F.lit(2.0**-60)) * FINE), F.lit(60 * FINE)).cast("int")


def proposed_moves(nodes: DataFrame, adj: DataFrame, rows: DataFrame, gamma: float, seed: int, step: int, active: DataFrame | None = None) -> DataFrame:
    """(node, at, to, gain, own, order): the best move of each node in active (node), or of all, if it gains. A new cluster has a number of its own."""
    gains = move_gains(nodes, adj, rows, gamma, asked=None if active is None else rows.join(active.select("node"), "node", "left_semi"))
    moves = best_moves(gains).filter("not stay and gain - here > 1e-12 * (1 + abs(here))")
    to = F.when(F.col("empty"), -1 - (F.col("node") * 4096 + step)).otherwise(F.col("cluster")).alias("to")
    return moves.select("node", "at", to, (F.col("gain") - F.col("here")).alias("gain"), "own", seeded_uniform(seed * 4096 + step, "node").alias("order"))


def sure_moves(adj: DataFrame, moves: DataFrame, gamma: float) -> DataFrame:
    """(node, cluster, gain): the proposed moves that gain in their order whichever of those before them are made; gain is what they bring at least."""
    i = moves.select(F.col("node").alias("src"), F.col("at").alias("i_at"), F.col("to").alias("i_to"), F.col("order").alias("i_order"))
    j = moves.select(F.col("node").alias("dst"), F.col("at").alias("j_at"), F.col("to").alias("j_to"), F.col("order").alias("j_order"))
    plus, minus = F.greatest("weight", F.lit(0.0)), F.greatest(-F.col("weight"), F.lit(0.0))
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    worse = plus * (one(F.col("j_at") == F.col("i_to")) + one(F.col("j_to") == F.col("i_at"))) + minus * (one(F.col("j_to") == F.col("i_to")) + one(F.col("j_at") == F.col("i_at")))
    before = adj.join(i, "src").join(j, "dst").filter("j_order < i_order or (j_order = i_order and dst < src)")
    loss = before.groupBy(F.col("src").alias("node")).agg(F.sum(worse).alias("loss"))
    placed = moves.withColumn("turn", _turn(F.col("order")))
    ends = placed.select("turn", "own", F.explode(F.array(F.struct(F.lit("at").alias("side"), F.col("at").alias("cluster")), F.struct(F.lit("to").alias("side"), F.col("to").alias("cluster")))).alias("e"))
    sums = ends.groupBy("e.side", "e.cluster", "turn").agg(F.sum("own").alias("w"))  # a few hundred turns for each cluster at most
    upto = F.sum("w").over(Window.partitionBy("side", "cluster").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    crowd = sums.withColumn("crowd", upto)
    left, come = (crowd.filter(F.col("side") == s).select(F.col("cluster").alias(s), "turn", F.col("crowd").alias(f"{s}_crowd")) for s in ("at", "to"))
    both = placed.join(left, ["at", "turn"]).join(come, ["to", "turn"]).join(loss, "node", "left")
    sure = F.col("gain") - F.coalesce("loss", F.lit(0.0)) - gamma * F.col("own") * (F.col("at_crowd") + F.col("to_crowd") - 2 * F.col("own"))
    return both.select("node", F.col("to").alias("cluster"), sure.alias("gain")).filter("gain > 0")


def by_least_node(rows: DataFrame) -> DataFrame:
    """(node, cluster) with clusters named by their least node."""
    least = rows.groupBy("cluster").agg(F.min("node").alias("_least"))
    return rows.join(least, "cluster").select("node", F.col("_least").alias("cluster"))


@dataclass
class Moved:
    """rows (node, cluster), the gain in all, for each step the nodes that were looked at, and the gain of the first."""

    rows: DataFrame
    gain: float
    looked_at: list[int]
    first: float | None = None


def dealt_moves(nodes: DataFrame, adj: DataFrame, rows: DataFrame, gamma: float, seed: int, step: int, most_rows: int, total: int) -> tuple[DataFrame, DataFrame, bool]:
    """((node, cluster, gain, met), written, (node) left out, whether there are any): rows' clusters are dealt to parts of about half of ``most_rows`` of the ``total`` adjacency
    rows each, and nodes move between those of their part by the kernel. Gains are exact and stand in one row of a part; met says that a node has an edge to another
    cluster of its part. Nodes of parts of more than most_rows are left out."""
    number = max(2, ceil(sqrt(2 * total / most_rows)))
    placed = rows.select("node", "cluster", F.pmod(F.xxhash64(F.lit(seed * 4096 + step), "cluster"), F.lit(number)).cast("long").alias("part"))
    a, b = placed.select(F.col("node").alias("src"), "part"), placed.select(F.col("node").alias("dst"), F.col("part").alias("other"))
    inner = materialize(adj.join(a, "src").join(b, "dst").filter("part = other").select("part", "src", "dst", "weight"))
    sizes = {r["part"]: r["count"] for r in inner.groupBy("part").count().collect()}  # about the root of twice the rows over most_rows
    fits, large = ([p for p, n in sizes.items() if (n <= most_rows) == x] for x in (True, False))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        weight, before = (left.column(c).to_numpy()[order] for c in ("weight", "cluster"))
        g = kernel.Graph.of(len(ids), *(np.searchsorted(ids, right.column(c).to_numpy()) for c in ("src", "dst")), right.column("weight").to_numpy(), weight)
        before = np.unique(before, return_inverse=True)[1]
        after, moved = kernel.local_move(g, before, gamma, np.random.default_rng([seed & 0xFFFFFFFF, step, key[0].as_py()]))
        src = g.sources()
        cut = before[src] != before[g.nbr]
        met, gain = np.zeros(len(ids), bool), np.zeros(len(ids))
        met[src[cut]] = True
        if moved:
            inside = g.wt @ ((after[src] == after[g.nbr]).astype(float) - ~cut)
            squares = (np.bincount(after, weight) ** 2).sum() - (np.bincount(before, weight) ** 2).sum()
            gain[0] = (inside - gamma * squares) / 2
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, after, ids)
        return pa.table({"node": ids, "cluster": least[after], "gain": gain, "met": met})

    held = placed.filter(F.col("part").isin(fits)).join(nodes.select(F.col("id").alias("node"), "weight"), "node")
    within = inner.filter(F.col("part").isin(fits))
    moves = materialize(held.groupBy("part").cogroup(within.groupBy("part")).applyInArrow(run, "node long, cluster long, gain double, met boolean"))
    drop(inner)
    return moves, placed.filter(F.col("part").isin(large)).select("node"), bool(large)


def moved_locally(
    network: Network, gamma: float, seed: int, start: DataFrame | None = None, active: DataFrame | None = None, steps: int = STEPS, least: float = LEAST_GAIN, most_rows: int | None = None, first: float | None = None,
    quiet: int = 0,
) -> Moved:
    """Supersteps from single nodes or rows (node, cluster), of all nodes or those in active (node), until a step gains less than the share ``least`` of
    ``first``, by default the first one's gain, or ``steps`` are done. Nodes without an edge to an active one never move.

    With ``most_rows``, of a task's graph, clusters are dealt to tasks, and QUIET steps in a row, of which ``quiet`` are done, have to gain as little; then active nodes
    are whole components."""
    rows = materialize(Clustering.self_clusters(network.nodes).rows if start is None else by_least_node(start))
    total, looked, scale = 0.0, [], first
    adj = network.adj if active is None or not most_rows else network.adj.join(active.select(F.col("node").alias("src")), "src", "left_semi")
    number = adj.count() if most_rows else 0
    for step in range(steps):
        if most_rows:
            some = rows if active is None else rows.join(active.select("node"), "node", "left_semi")
            new, gain, seen = _dealt_step(network, adj, rows, some, gamma, seed, step, most_rows, number)
            following = active
        else:
            seen = network.nodes.count() if active is None else active.count()
            new, gain, following = _sure_step(network, rows, gamma, seed, step, active)
            if step and active is not None:
                drop(active)
        looked.append(seen)
        if new is not None:
            drop(rows)
            rows = new
        active, total = following, total + gain
        scale, first = scale or gain, first or gain
        quiet = quiet + 1 if gain <= 0 or gain < least * scale else 0
        if quiet == (QUIET if most_rows else 1):
            break
    return Moved(rows, total, looked, first)


def _sure_step(network: Network, rows: DataFrame, gamma: float, seed: int, step: int, active: DataFrame | None) -> tuple[DataFrame | None, float, DataFrame | None]:
    """(new rows, gain, the nodes to look at next) of one step of sure moves; no rows if there are none."""
    moves = materialize(proposed_moves(network.nodes, network.adj, rows, gamma, seed, step, active))
    sure = materialize(sure_moves(network.adj, moves, gamma))
    gain = sure.agg(F.coalesce(F.sum("gain"), F.lit(0.0))).first()[0]
    new, following = None, None
    if gain > 0:
        new = materialize(Clustering(rows).update(sure).rows)
        turned_down = moves.select("node").join(sure.select("node"), "node", "left_anti")
        following = materialize(requeued(network.adj, new, sure).union(turned_down).distinct())
    drop(moves)
    drop(sure)
    return new, gain, following


def _dealt_step(network: Network, adj: DataFrame, rows: DataFrame, some: DataFrame, gamma: float, seed: int, step: int, most_rows: int, total: int) -> tuple[DataFrame | None, float, int]:
    """(new rows, gain, nodes that met another cluster) of one step: clusters of some of the rows are dealt to tasks, and nodes that none takes make sure moves."""
    moves, left_out, any_left = dealt_moves(network.nodes, adj, some, gamma, seed, step, most_rows, total)
    told = moves.agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"), F.count(F.when(F.col("met"), 1)).alias("n")).first()
    new, gain, seen = None, told["gain"], told["n"]
    if gain > 0:
        new = materialize(Clustering(rows).update(moves.select("node", "cluster")).rows)
    if any_left:
        left_out = materialize(left_out)
        seen += left_out.count()
        sure, more, following = _sure_step(network, rows if new is None else new, gamma, seed, step, left_out)
        if sure is not None:
            drop(following)
            new, old = materialize(by_least_node(sure)), new
            for df in (sure, *([] if old is None else [old])):
                drop(df)
        gain += more
        drop(left_out)
    drop(moves)
    return new, gain, seen


def refined_whole(network: Network, rows: DataFrame, gamma: float, seed: int, randomness: float, most_rows: int) -> DataFrame:
    """(node, part), written: parts of each cluster of rows (node, cluster) by the kernel, clusters of up to ``most_rows`` adjacency rows whole in a task; those of
    larger ones by :func:`refined`. Parts are named by one of their nodes."""
    inner = materialize(clustered_edges(network.adj, rows).filter("c1 = c2").select(F.col("c1").alias("cluster"), "src", "dst", "weight"))
    sizes = materialize(inner.groupBy("cluster").agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = sizes.filter(F.col("n") <= most_rows).select("cluster", bin_of("cluster", F.col("n"), total, most_rows).alias("bin"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        weight, cluster = (left.column(c).to_numpy()[order] for c in ("weight", "cluster"))
        g = kernel.Graph.of(len(ids), *(np.searchsorted(ids, right.column(c).to_numpy()) for c in ("src", "dst")), right.column("weight").to_numpy(), weight)
        cluster = np.unique(cluster, return_inverse=True)[1]
        part = kernel.refine(g, cluster, gamma, randomness, False, np.random.default_rng([seed & 0xFFFFFFFF, int(ids[0])]))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, part, ids)
        return pa.table({"node": ids, "to": least[part]})

    nodes = network.nodes.select(F.col("id").alias("node"), "weight").join(rows, "node").join(dealt, "cluster")
    again = dealt.select(F.col("cluster").alias("cluster"), F.col("bin").alias("of"))  # new columns, for sides of one origin
    found = nodes.groupBy("bin").cogroup(inner.join(again, "cluster").select("of", "src", "dst", "weight").groupBy("of")).applyInArrow(run, "node long, to long")
    large = sizes.filter(F.col("n") > most_rows).select("cluster")
    if large.limit(1).count():
        held = materialize(rows.join(large, "cluster", "left_semi").select("node", "cluster"))
        ends = inner.join(large, "cluster", "left_semi").select("src", "dst", "weight")
        some = Network(network.nodes.join(held.select(F.col("node").alias("id")), "id", "left_semi"), ends, None, network.use_modularity)
        found = found.union(refined(some, held, gamma, seed, randomness).select("node", F.col("part").alias("to")))
    parts = materialize(rows.select("node").join(found, "node", "left").select("node", F.coalesce("to", "node").alias("part")))
    drop(inner)
    drop(sizes)
    return parts


def refined(network: Network, rows: DataFrame, gamma: float, seed: int, randomness: float = 0.001, rounds: int = ROUNDS) -> DataFrame:
    """(node, part), written: parts of each cluster of rows (node, cluster), merged from single nodes and named by one of theirs.

    In each round parts fall in two by a coin. A node of the first half that is still alone and well connected to its cluster draws a part of the second
    half, by chance in proportion to the exponent of the gain over ``randomness``, or itself. Of those that drew it a part takes, in a random order, all that gain
    though the others before them come too, if it is well connected with them, or else the first alone, if it is so with that one. Cuts and weights follow what was
    merged. So every part of two nodes or more is well connected to the rest of its cluster."""
    inner = materialize(clustered_edges(network.adj, rows).filter("c1 = c2").select("src", "dst", "weight"))
    held = network.nodes.join(rows, F.col("id") == F.col("node")).select("node", "cluster", "weight")
    totals = held.groupBy("cluster").agg(F.sum("weight").alias("total"))
    cuts = inner.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("cut"))
    parts = materialize(rows.select("node", F.col("node").alias("part")))
    state = held.join(totals, "cluster").join(cuts, "node", "left")
    state = materialize(state.select(F.col("node").alias("part"), F.col("weight").alias("held"), "total", F.coalesce("cut", F.lit(0.0)).alias("cut"), F.lit(1).cast("long").alias("n")))
    number = state.count()
    for r in range(rounds):
        drawn = materialize(_drawn(inner, parts, state, gamma, seed * 4096 + r, randomness))
        taken = materialize(_taken(inner, drawn, gamma))
        merged = taken.agg(F.sum("n")).first()[0] or 0
        if merged:
            all_, one = taken.filter("n > 1").select("part"), taken.filter("n = 1").select(F.col("first").alias("src"), "part")
            joined = drawn.filter("comes").join(all_, "part", "left_semi").select("src", "part").union(one)
            new = materialize(parts.join(joined.select(F.col("src").alias("node"), F.col("part").alias("to")), "node", "left").select("node", F.coalesce("to", "part").alias("part")))
            left = state.join(joined.select(F.col("src").alias("part")), "part", "left_anti").join(taken.select("part", F.col("held").alias("to_held"), F.col("cut").alias("to_cut"), F.col("n").alias("more")), "part", "left")
            grown = materialize(left.select("part", F.coalesce("to_held", "held").alias("held"), "total", F.coalesce("to_cut", "cut").alias("cut"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
            drop(parts)
            drop(state)
            parts, state = new, grown
        drop(drawn)
        drop(taken)
        if merged < LEAST_MERGED * number:
            break
        number -= merged
    drop(inner)
    drop(state)
    return parts


def _drawn(inner: DataFrame, parts: DataFrame, state: DataFrame, gamma: float, seed: int, randomness: float) -> DataFrame:
    """(src, part, own, own_cut, near, held, cut, total, order, comes): the part that each node alone draws, if it isn't itself, with the weights and cuts of both; comes
    says that it gains though all before it in the order come too."""
    heads = seeded_uniform(seed, "part") < 0.5
    able = state.filter(well_connected(F.col("cut"), F.col("held"), F.col("total"), gamma))
    alone = able.filter(heads & (F.col("n") == 1)).select(F.col("part").alias("src"), F.col("held").alias("own"), F.col("cut").alias("own_cut"))
    takers = able.filter(~heads).select("part", "held", "cut", "total")
    ends = parts.select(F.col("node").alias("dst"), "part")
    near = inner.join(alone, "src").join(ends, "dst").groupBy("src", "part").agg(F.sum("weight").alias("near"), F.first("own").alias("own"), F.first("own_cut").alias("own_cut"))
    options = near.join(takers, "part").withColumn("gain", F.col("near") - gamma * F.col("own") * F.col("held")).filter("gain >= 0")
    luck = lambda *names: F.log(-F.log(seeded_uniform(seed, *names) + F.lit(2.0**-60)))  # noqa: E731  an exponential race, by logarithms
    race = luck("src", "part") - log_exponent(F.col("gain") / randomness)
    values = F.struct("part", "own", "own_cut", "near", "held", "cut", "total", "gain")
    drawn = options.filter(race <= luck("src", "src")).groupBy("src").agg(F.min_by(values, F.struct(race, "part")).alias("d")).select("src", "d.*")
    drawn = drawn.withColumn("order", seeded_uniform(seed + 1, "src")).withColumn("turn", _turn(F.col("order")))
    sums = drawn.groupBy("part", "turn").agg(F.sum("own").alias("w"))  # a few hundred turns for each part at most
    crowd = sums.withColumn("crowd", F.sum("w").over(Window.partitionBy("part").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)))
    comes = F.col("gain") - gamma * F.col("own") * (F.col("crowd") - F.col("own")) >= 0
    return drawn.join(crowd.select("part", "turn", "crowd"), ["part", "turn"]).withColumn("comes", comes).drop("turn", "crowd", "gain")


def _taken(inner: DataFrame, drawn: DataFrame, gamma: float) -> DataFrame:
    """(part, held, cut, n, first): what a part is after a round: with n nodes more, all that come or the first alone."""
    come = drawn.filter("comes")
    a, b = come.select("src", F.col("part").alias("p1")), come.select(F.col("src").alias("dst"), F.col("part").alias("part"))
    among = inner.join(a, "src").join(b, "dst").filter("p1 = part").groupBy("part").agg(F.sum("weight").alias("among"))
    came = come.groupBy("part").agg(F.sum("own").alias("more"), F.sum(F.col("own_cut") - 2 * F.col("near")).alias("change"), F.count("*").alias("n"))
    one_cut, one_held = F.col("cut") + F.col("own_cut") - 2 * F.col("near"), F.col("held") + F.col("own")
    lone = drawn.filter(well_connected(one_cut, one_held, F.col("total"), gamma)).groupBy("part").agg(F.min_by(F.struct("src", one_held.alias("held"), one_cut.alias("cut")), F.struct("order", "src")).alias("lone"))
    base = drawn.groupBy("part").agg(*[F.first(c).alias(c) for c in ("held", "cut", "total")])
    told = base.join(came, "part", "left").join(among, "part", "left").join(lone, "part", "left")
    held, cut = F.col("held") + F.col("more"), F.col("cut") + F.col("change") - F.coalesce("among", F.lit(0.0))
    whole = (F.col("n") > 1) & well_connected(cut, held, F.col("total"), gamma)
    pick = lambda a, b: F.when(whole, a).otherwise(b)
    out = told.select("part", pick(held, F.col("lone.held")).alias("held"), pick(cut, F.col("lone.cut")).alias("cut"), pick(F.col("n"), F.lit(1)).cast("long").alias("n"), F.col("lone.src").alias("first"), (whole | F.col("lone").isNotNull()).alias("some"))
    return out.filter("some").drop("some")


def contracted(network: Network, parts: DataFrame) -> Network:
    """Parts (node, part) as nodes of their own numbers, written; edges between two parts are summed, those inside left out."""
    held = network.nodes.join(parts, F.col("id") == F.col("node")).groupBy("part").agg(F.sum("weight").alias("weight"))
    sums = clustered_edges(network.adj, parts.select("node", F.col("part").alias("cluster"))).filter("c1 <> c2").groupBy(F.col("c1").alias("src"), F.col("c2").alias("dst")).agg(F.sum("weight").alias("weight"))
    nodes = held.select(F.col("part").alias("id"), F.col("part").cast("string").alias("label"), "weight")
    return Network(materialize(nodes), materialize(sums), None, network.use_modularity, 0.0)


def connected_pieces(network: Network, rows: DataFrame) -> DataFrame:
    """(node, cluster): clusters split into their components, each named by its least node."""
    inner = clustered_edges(network.adj, rows).filter("c1 = c2").select("src", "dst")
    return connected_components(network.nodes.select("id"), inner).select(F.col("id").alias("node"), F.col("component").alias("cluster"))


@dataclass
class Level:
    """A network, the group of each of its nodes, its rows after moving, the part of each node that is a node of the next level, and the gain of the first step."""

    network: Network
    owner: DataFrame
    rows: DataFrame
    parts: DataFrame | None = None
    first: float | None = None


def _rows_of(network: Network, owner: DataFrame) -> DataFrame:
    """(grp, n): adjacency rows of each group."""
    return network.adj.join(owner.select(F.col("node").alias("src"), "grp"), "src").groupBy("grp").agg(F.count("*").alias("n"))


def shrunk(network: Network, owner: DataFrame, gamma: float, seed: int, most_rows: int, start: DataFrame | None = None, randomness: float = 0.001, depth: int = DEPTH) -> tuple[list[Level], DataFrame]:
    """(levels from the network down, (grp) that is still too large) of a network whose groups, owner (node, grp), share no edge.

    Groups of more than ``most_rows`` adjacency rows are moved, refined and contracted, from single nodes or rows (node, cluster); those within it
    stay as they are from then on. A group is too large at the end where contraction comes to a halt before."""
    rows = materialize(Clustering.self_clusters(network.nodes).rows if start is None else start.select("node", "cluster"))
    levels, before = [Level(network, owner, rows)], None
    for k in range(depth):
        level = levels[-1]
        sizes = _rows_of(level.network, level.owner).filter(F.col("n") > most_rows)
        now = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        if not now["k"] or (before is not None and now["n"] > (1 - LEAST_SHRUNK) * before):
            break
        before = now["n"]
        open_ = materialize(level.owner.join(sizes.select("grp"), "grp", "left_semi").select("node", "grp"))
        moved = moved_locally(level.network, gamma, seed + k, level.rows, open_.select("node"), least=LEAST_DOWN, most_rows=most_rows, first=levels[0].first)
        level.rows, level.first = moved.rows, moved.first
        ends = open_.select(F.col("node").alias("src"))
        part_of = Network(level.network.nodes.join(open_.select(F.col("node").alias("id")), "id", "left_semi"), level.network.adj.join(ends, "src", "left_semi"), None, network.use_modularity)
        fine = refined_whole(part_of, level.rows.join(open_, "node", "left_semi"), gamma, seed + k, randomness, most_rows)
        rest = level.rows.join(fine, "node", "left_anti").select("node", F.col("node").alias("part"))
        level.parts = materialize(fine.union(rest))
        small = contracted(level.network, level.parts)
        names = level.parts.filter("node = part").select("part")
        on = lambda df: materialize(df.join(names.withColumnRenamed("part", "node"), "node", "left_semi"))
        levels.append(Level(small, on(level.owner.select("node", "grp")), on(level.rows.select("node", "cluster"))))
    last = levels[-1]
    return levels, materialize(_rows_of(last.network, last.owner).filter(F.col("n") > most_rows).select("grp"))


def unrolled(levels: list[Level], rows: DataFrame, gamma: float, seed: int, most_rows: int | None = None) -> DataFrame:
    """(node, cluster) of the first level from rows of the last: projected level by level, and moved on at each."""
    for k in reversed(range(len(levels))):
        level = levels[k]
        if level.parts is not None:
            rows = level.parts.join(rows.select(F.col("node").alias("part"), "cluster"), "part").select("node", "cluster")
            quiet = 0
            if most_rows:  # a look at all clusters at once, before they are dealt, which is a quiet step like any other if it gains as little
                look = moved_locally(level.network, gamma, seed + DEPTH + k, rows, None, 1)
                rows, quiet = look.rows, int(look.gain < LEAST_GAIN * (levels[0].first or 0.0))
            rows = moved_locally(level.network, gamma, seed + DEPTH + k, rows, None, STEPS_UP, most_rows=most_rows, first=levels[0].first, quiet=quiet).rows
    return rows
