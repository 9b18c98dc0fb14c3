import numpy as np
from pyspark.sql import functions as F

from communa.operators import components
from communa.operators.network import Network
from communa.plans import engine, kernel

EDGES = "src string, dst string, weight double, ord long"


def stars(spark, number, leaves):
    return spark.createDataFrame([(f"o{h}_{i}", f"c{h}", 1.0, h * leaves + i) for h in range(number) for i in range(leaves)], EDGES)


def test_graphs_of_their_own_resolutions_are_one_graph():
    """A pair of 4-cliques with a bridge is whole under a small resolution and two cliques under its own, side by side."""
    one = [(a + 4 * s, b + 4 * s) for s in range(2) for a in range(4) for b in range(a)] + [(3, 4)]
    src, dst = np.array([(a + 8 * k, b + 8 * k) for k in range(150) for a, b in one + [(b, a) for a, b in one]]).T
    g = kernel.Graph.of(1200, src, dst, np.ones(len(src)), np.bincount(src).astype(float))
    gamma = np.where(np.arange(1200) // 8 % 2, 1 / 26, 1e-6)
    found, _ = kernel.leiden(g, np.arange(1200), gamma, 0.001, 2, True, np.random.default_rng(1))
    assert [len(set(x)) for x in found.reshape(150, 8).tolist()] == [1, 2] * 75
    assert len(set(found.tolist())) == 225


def test_bins_of_small_groups_are_a_share(spark):
    n = Network.from_edges(stars(spark, 400, 10)).kept()
    nodes, adj = engine.binned(n.nodes, n.adj, None, 4000)
    sizes = [r["count"] for r in adj.groupBy("bin").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2000 and len(sizes) > 8
    assert nodes.select("id", F.col("bin").alias("b")).join(adj.select("src", "bin"), F.col("id") == F.col("src")).filter("b <> bin").count() == 0


def test_components_are_found_once(spark, monkeypatch):
    calls = []
    plain = engine.connected_components
    monkeypatch.setattr(engine, "connected_components", lambda *a: (calls.append(1), plain(*a))[1])
    n = Network.from_edges(stars(spark, 40, 10)).kept()
    found = engine.leiden_clustering(n, seed=1, kernel_rows=500, bin_rows=100)[1]
    assert found.rows.agg(F.countDistinct("cluster")).first()[0] == 40 and len(calls) == 1


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    plain = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: (written.append(1), plain(df))[1])
    edges = spark.createDataFrame([(i, i // 10 * 10) for i in range(100) if i % 10], "u long, v long")
    assert sorted(map(tuple, components.component_edges(edges).collect())) == [(i, i // 10 * 10) for i in range(100) if i % 10]
    assert len(written) == 1


def test_components_contract_their_pairs(spark, monkeypatch):
    """Pairs are put between roots: of the pairs of one component of 400 nodes, five for each, no tenth comes to the last round."""
    pairs, plain = [], components.materialize

    def counted(df):
        out = plain(df)
        if set(out.columns) == {"u", "v"}:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    drawn = np.random.default_rng(1).integers(0, 200, (2000, 2))
    edges = spark.createDataFrame([(int(a), 200 + int(b)) for a, b in drawn] + [(900, 901), (901, 902), (902, 903)], "u long, v long")
    found = dict(map(tuple, components.component_edges(edges).collect()))
    assert found == {x: 0 for x in range(1, 400)} | {901: 900, 902: 900, 903: 900}
    assert pairs[-1] < pairs[0] / 10
