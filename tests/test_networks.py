import math

import pytest
from pyspark.sql import functions as F

from communa import api, cli
from communa.errors import (
    ClusterIndexingError, EdgeFileFormatError, EmptyNetworkError, InternalNetworkIndexingError, InvalidCommunityMappingError, ParameterRangeError, UnsafeInducementError,
)
from communa.functions import table
from communa.graphs import graph
from communa.operators import moves, partition, scoring, transforms
from communa.operators.components import connected_components
from communa.operators.network import Network
from communa.operators.partition import Clustering, contiguous
from communa.plans import engine, supersteps
from communa.plans.engine import leiden_clustering
from communa.plans.hierarchy import hierarchical_clustering
from communa.sources.edges import edges_from_rows, partition_lines, read_edge_file
from communa.streaming.rescore import rescore

# The edges of the organisation graph (FIXTURES.md, F1), its two components, and the graph of eight letters (F3).
ORG = [
    ("dwayne", "nick", 10.0), ("jon", "dwayne", 5.0), ("carolyn", "dwayne", 5.0), ("chris", "david", 5.0),
    ("amber", "david", 15.0), ("nathan", "chris", 10.0), ("patrick", "dwayne", 10.0), ("bryan", "carolyn", 10.0),
]
ONE = {"dwayne": 0, "nick": 0, "jon": 0, "carolyn": 0, "bryan": 0, "patrick": 0, "chris": 1, "david": 1, "amber": 1, "nathan": 1}
LETTERS = [
    ("a", "b", 2.0), ("a", "d", 1.0), ("a", "e", 1.0), ("b", "a", 2.0), ("b", "c", 6.0), ("b", "e", 1.0), ("b", "f", 4.0), ("b", "g", 3.0), ("c", "b", 6.0),
    ("c", "g", 3.0), ("d", "a", 1.0), ("d", "h", 11.0), ("e", "a", 1.0), ("e", "b", 1.0), ("f", "b", 4.0), ("g", "b", 3.0), ("g", "c", 3.0), ("h", "d", 11.0),
]


def org():
    return list(ORG)


def letters(spark):
    return edges_from_rows(spark, LETTERS)


def rows(spark, values, next_id=None):
    return Clustering(spark.createDataFrame(list(enumerate(values)), "node long, cluster long"), next_id)


def listed(c):
    return [r.cluster for r in c.rows.orderBy("node").collect()]


def test_first_seen_ids_and_weights(spark):
    n = Network.from_edges(letters(spark))
    found = [(r.label, r.weight) for r in n.nodes.orderBy("id").collect()]
    assert found == [("a", 4), ("b", 16), ("d", 12), ("e", 2), ("c", 9), ("f", 4), ("g", 6), ("h", 11)]
    assert [r.id for r in n.neighbors_for(1).orderBy("id").collect()] == [0, 3, 4, 5, 6]
    assert n.totals == {"num_nodes": 8, "num_edges": 9, "total_node_weight": 64.0, "total_edge_weight": 32.0, "total_self_links_edge_weight": 0.0}
    assert n.edge_weight("b", "c") == 6 and n.edge_weight("a", "h") is None and n.node_weight(2) == 12
    with pytest.raises(InternalNetworkIndexingError):
        n.node_weight(99)
    assert {r.weight for r in Network.from_edges(letters(spark), False).nodes.collect()} == {1.0}


@pytest.mark.parametrize(
    ("extra", "communities", "gamma", "want"),
    [
        ([], ONE, 1, 0.489795918), ([], ONE | {"dwayne": 2, "nathan": 2}, 1, 0.091836735), ([], {}, 1, -0.122448980), ([], dict.fromkeys(ONE, 0), 1, 0.0),
        ([("dwayne", "dwayne", 7.0), ("nick", "dwayne", 99.0)], ONE, 1, 0.510645817),
    ],
)
def test_modularity(spark, extra, communities, gamma, want):
    found = communities or spark.createDataFrame([], "node string, cluster long")
    assert api.modularity(edges_from_rows(spark, org() + extra), found, gamma) == pytest.approx(want, abs=1e-9)


def test_cpm_and_no_edges(spark):
    n = Network.from_edges(edges_from_rows(spark, org()), False)
    c = partition.starting_communities(n.nodes, spark.createDataFrame(list(ONE.items()), "node string, cluster long"))
    assert scoring.quality(n, c, 1) == pytest.approx(0.628571429, abs=1e-9) and scoring.quality(n, c, 0.05) == pytest.approx(0.981428571, abs=1e-9)
    none = spark.createDataFrame([], "src string, dst string, weight double, ord long")
    assert math.isnan(api.modularity(none, spark.createDataFrame([], "node string, cluster long")))


def test_partition_algebra(spark):
    c = rows(spark, [3, 3, 5, 1, 2, 2, 9, 0])
    assert listed(c.compacted()) == [3, 3, 4, 1, 2, 2, 5, 0] and c.compacted().next_cluster_id() == 6
    c = rows(spark, [1, 1, 4, 3, 0, 0, 5, 2])
    assert listed(c.composed(rows(spark, [0, 2, 2, 3, 4, 4]))) == [2, 2, 4, 3, 0, 0, 4, 2]
    assert [r.n for r in c.sizes().orderBy("cluster").collect()] == [2, 2, 1, 1, 1, 1]
    assert [r.members for r in c.members().orderBy("cluster").collect()] == [[4, 5], [0, 1], [7], [3], [2], [6]]
    empty = Clustering.empty(spark)
    assert listed(empty.compacted()) == [] and empty.next_cluster_id() == 0 and empty.sizes().count() == 0
    assert c.cluster_at(2) == 4 and c.num_nodes() == 8
    with pytest.raises(ClusterIndexingError):
        c.cluster_at(8)
    counts = spark.createDataFrame(list(enumerate([1, 1, 2, 3, 5, 8])), "cluster long, parts long")
    assert listed(partition.induced_initial(counts)) == [i for i, n in enumerate([1, 1, 2, 3, 5, 8]) for _ in range(n)]


def test_sanity_split(spark):
    n = Network.from_edges(letters(spark))
    found = listed(partition.sanity_split(n.adj, rows(spark, [0, 1, 2, 1, 1, 1, 1, 0])))
    assert found == [3, 1, 2, 1, 1, 1, 1, 4]


def test_contraction(spark):
    edges = [("jon", "nick", 10), ("dwayne", "nick", 2), ("carolyn", "nick", 5), ("carolyn", "amber", 1), ("chris", "david", 8), ("chris", "nathan", 12), ("chris", "amber", 4)]
    n = Network.from_edges(edges_from_rows(spark, edges))
    order = [r.label for r in n.nodes.orderBy("id").collect()]
    assert order == ["jon", "nick", "dwayne", "carolyn", "amber", "chris", "david", "nathan"]
    c = rows(spark, [0, 0, 1, 0, 2, 2, 2, 2])
    small = transforms.induced_network(n, c)
    assert [r.weight for r in small.nodes.orderBy("id").collect()] == [33, 2, 49]
    assert {(r.src, r.dst): r.weight for r in small.adj.collect()} == {(0, 1): 2, (0, 2): 1, (1, 0): 2, (2, 0): 1}
    assert small.totals["total_self_links_edge_weight"] == 78
    assert scoring.quality(n, c) == pytest.approx(0.433390023, abs=1e-9)


def communities(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.cluster, set()).add(r.node)
    return sorted(map(frozenset, out.values()), key=sorted)


def test_leiden_on_three_communities(spark):
    # FIXTURES.md, F5
    pairs = [
        ("dwayne", "nick"), ("nick", "jon"), ("jon", "carolyn"), ("nick", "carolyn"), ("dwayne", "jon"), ("carolyn", "amber"),
        ("amber", "chris"), ("amber", "nathan"), ("nathan", "chris"), ("jarkko", "thirteen"),
    ]
    want = [{"amber", "chris", "nathan"}, {"carolyn", "dwayne", "jon", "nick"}, {"jarkko", "thirteen"}]
    score, found = api.leiden(edges_from_rows(spark, [(a, b, 15.0) for a, b in pairs]), seed=1234)
    assert communities(found) == [frozenset(x) for x in want] and score == pytest.approx(0.465)


def test_leiden_separates_unconnected_start(spark):
    start = ONE | {"dwayne": 2, "nathan": 2}
    for seed in range(3):
        clusters = {r.node: r.cluster for r in api.leiden(edges_from_rows(spark, org()), start, seed=seed)[1].collect()}
        assert clusters["dwayne"] != clusters["nathan"]


def test_same_seed_same_result_for_any_dealing(spark):
    edges = graph(spark, "/root/testdata/sf0.001", "cust_supp")
    first = {r.node: r.cluster for r in api.leiden(edges, seed=3)[1].collect()}
    again = {r.node: r.cluster for r in api.leiden(edges.repartition(7), seed=3)[1].collect()}
    assert first == again and set(first.values()) == set(range(max(first.values()) + 1))


@pytest.mark.parametrize("use_modularity", [True, False])
def test_sure_moves_gain_what_they_say(spark, use_modularity):
    """Many moves at once bring no less than the sum of their bounds, from single nodes and from crowded clusters."""
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "part_copurchase"), use_modularity).kept()
    gamma = scoring.adjusted_resolution(n, 1.0 if use_modularity else 0.6)
    score = lambda c: scoring.quality(n, c, 1.0 if use_modularity else 0.6)
    for start in (Clustering.self_clusters(n.nodes), Clustering(n.nodes.select(F.col("id").alias("node"), (F.col("id") % 7).alias("cluster")))):
        drawn = supersteps.proposed_moves(n.nodes, n.adj, start.rows, gamma, 3, 0).cache()
        sure = supersteps.sure_moves(n.adj, drawn, gamma).cache()
        bound = 2 * sure.agg(F.sum("gain")).first()[0] / (2 * n.totals["total_edge_weight"])
        found = score(start.update(sure)) - score(start)
        print("moves", drawn.count(), "sure", sure.count(), "bound", bound, "gain", found)
        assert sure.count() > 1 and found >= bound - 1e-12 > 0
        first = drawn.filter(F.col("order") == drawn.agg(F.min("order")).first()[0]).join(sure, "node", "left_anti")
        assert first.count() == 0  # the first in the order is never turned down


def test_dealt_moves_gain_what_they_say(spark):
    """Nodes moved in tasks bring exactly the gain that is told; clusters that no task holds make sure moves; and fewer steps end higher than sure moves alone."""
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "part_copurchase")).kept()
    gamma, total = scoring.adjusted_resolution(n, 1.0), n.adj.count()
    score = lambda rows: scoring.quality(n, Clustering(rows), 1.0)
    rows = Clustering.self_clusters(n.nodes).rows
    moved, _, left = supersteps.dealt_moves(n.nodes, n.adj, rows, gamma, 3, 0, total // 10, total)
    new = Clustering(rows).update(moved.select("node", "cluster")).rows
    told = 2 * moved.agg(F.sum("gain")).first()[0] / total_weight(n)
    assert not left and told > 0 and score(new) - score(rows) == pytest.approx(told, abs=1e-9)
    one = n.nodes.select(F.col("id").alias("node"), (F.col("id") % 2).alias("cluster"))
    moved, out, left = supersteps.dealt_moves(n.nodes, n.adj, one, gamma, 3, 0, total // 10, total)
    assert left and out.count() == n.nodes.count() and moved.count() == 0
    apart = supersteps.moved_locally(n, gamma, 3, one, None, 1, most_rows=total // 10)
    assert apart.gain > 0 and score(apart.rows) - score(one) >= 2 * apart.gain / total_weight(n) - 1e-12
    dealt, sure = supersteps.moved_locally(n, gamma, 3, most_rows=total // 4), supersteps.moved_locally(n, gamma, 3)
    print("dealt", score(dealt.rows), len(dealt.looked_at), "sure", score(sure.rows), len(sure.looked_at))
    assert score(dealt.rows) > score(sure.rows) and len(dealt.looked_at) < len(sure.looked_at)


def test_a_quiet_look_counts_as_a_step(spark):
    """After a look that gained as little as a quiet step, one more quiet step ends local moving, not two."""
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "cust_supp")).kept()
    gamma, rows = scoring.adjusted_resolution(n, 1.0), leiden_clustering(n, None, 1.0, seed=2)[1].rows
    limit = n.adj.count() // 4
    looks = [len(supersteps.moved_locally(n, gamma, 3, rows, None, 8, most_rows=limit, first=1e9, quiet=q).looked_at) for q in (0, 1)]
    assert looks == [2, 1]


def total_weight(n):
    return 2 * n.totals["total_edge_weight"]


@pytest.mark.parametrize("name", ["cust_supp", "part_copurchase"])
def test_supersteps_match_the_kernel(spark, name, monkeypatch):
    """With a tenth of the rows as limit: 0.98 of the kernel's quality at least, no group over the limit in a task, fewer nodes looked at from step to step."""
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", name)).kept()
    limit, sizes, steps = n.adj.count() // 10, [], []
    whole = leiden_clustering(n, None, 1.0, seed=2)[1]
    solve, moved = engine.solve, supersteps.moved_locally
    monkeypatch.setattr(engine, "solve", lambda nodes, adj, *a: sizes.append(adj.groupBy("grp").count().agg(F.max("count")).first()[0]) or solve(nodes, adj, *a))
    monkeypatch.setattr(supersteps, "moved_locally", lambda *a, **k: steps.append(moved(*a, **k)) or steps[-1])
    improved, parts = leiden_clustering(n, None, 1.0, seed=2, kernel_rows=limit, bin_rows=300)
    best, other = (scoring.quality(n, x) for x in (whole, parts))
    print("kernel", best, "supersteps", other, [x.looked_at for x in steps], sizes)
    assert improved and other >= 0.98 * best and parts.num_nodes() == n.totals["num_nodes"]
    assert all((x or 0) <= limit for x in sizes)
    assert len(steps) > 2 and min(steps[0].looked_at) < steps[0].looked_at[0] and steps[-1].looked_at[-1] < n.totals["num_nodes"]
    inner = transforms.clustered_edges(n.adj, parts.rows).filter("c1 = c2")
    pieces = connected_components(n.nodes, inner).join(parts.rows, F.col("id") == F.col("node")).groupBy("cluster").agg(F.countDistinct("component").alias("k"))
    assert pieces.agg(F.max("k")).first()[0] == 1


@pytest.mark.parametrize("use_modularity", [True, False])
def test_refined_parts_are_well_connected(spark, use_modularity):
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "part_copurchase"), use_modularity).kept()
    gamma = scoring.adjusted_resolution(n, 1.0 if use_modularity else 0.6)
    clusters = n.nodes.select(F.col("id").alias("node"), (F.col("id") % 3).alias("cluster"))
    parts = supersteps.refined(n, clusters, gamma, 5)
    both = parts.join(clusters, "node").join(n.nodes, F.col("id") == F.col("node"))
    groups = both.groupBy("part").agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("n"), F.max(F.col("node") == F.col("part")).alias("named"))
    assert parts.count() == n.nodes.count() and groups.agg(F.max("k")).first()[0] == 1 and groups.agg(F.min("named")).first()[0]
    assert groups.count() < 0.85 * parts.count() and groups.agg(F.max("n")).first()[0] > 2
    edges = transforms.subnetworks(n.adj, Clustering(clusters))
    well = moves.connected_well(edges, both.select("cluster", "id", "weight"), parts, gamma)
    assert well.join(groups.filter("n > 1").select("part"), "part", "left_semi").filter("not well").count() == 0
    inner = edges.select("src", "dst").join(parts.select(F.col("node").alias("src"), F.col("part").alias("p1")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("p2")), "dst").filter("p1 = p2")
    assert connected_components(n.nodes, inner).select("component").distinct().count() == groups.count()


def ring(spark):
    """Four cliques of five in a ring."""
    edges = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcd" for i in range(5) for j in range(i)] + [(f"{c}0", f"{d}1", 1.0) for c, d in zip("abcd", "bcda", strict=True)]
    return Network.from_edges(edges_from_rows(spark, edges)).kept()


def test_an_optimal_start_is_not_improved(spark):
    n = ring(spark)
    start = Clustering(n.nodes.select(F.col("id").alias("node"), F.ascii("label").cast("long").alias("cluster")))
    other = Clustering(n.nodes.select(F.col("id").alias("node"), (F.col("id") % 4).alias("cluster")))
    for rows in (engine.KERNEL_ROWS, 10):
        improved, found = leiden_clustering(n, start, 1.0, seed=1, kernel_rows=rows)
        assert not improved and listed(found) == listed(Clustering(contiguous(start.rows)))
    assert leiden_clustering(n, other, 1.0, seed=1, kernel_rows=60)[0]


def test_trials_over_the_size_of_a_task(spark):
    """Each trial goes through the supersteps; the first has the random numbers of a run alone."""
    n = ring(spark)
    one, many = (scoring.quality(n, leiden_clustering(n, None, 1.0, seed=4, trials=t, kernel_rows=60)[1]) for t in (1, 3))
    print("one", one, "three", many)
    assert many >= one - 1e-12 and many > 0.6


def test_bins_of_components(spark):
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "stars")).kept()
    one, many = (leiden_clustering(n, None, 1.0, seed=1, bin_rows=b)[1] for b in (engine.BIN_ROWS, 100))
    assert listed(one) == listed(many)


def test_parameters(spark):
    edges, none = edges_from_rows(spark, org()), spark.createDataFrame([], "src string, dst string, weight double, ord long")
    for bad in ({"randomness": 0.0}, {"resolution": 0.0}, {"trials": 0}, {"iterations": -1}, {"seed": -1}):
        with pytest.raises(ParameterRangeError):
            api.leiden(edges, **bad)
    with pytest.raises(EmptyNetworkError):
        api.leiden(none)
    with pytest.raises(ValueError):
        api.leiden(edges, {"dwayne": -1})


def test_misses_raise(spark):
    n = Network.from_edges(letters(spark)).kept()
    part = rows(spark, [0, 1, 2])
    with pytest.raises(ClusterIndexingError):
        scoring.quality(n, part)
    with pytest.raises(Exception, match="not in the partition"):
        scoring.quality_rows(n, part).collect()
    with pytest.raises(UnsafeInducementError):
        transforms.induced_network(n, part)
    with pytest.raises(ClusterIndexingError):
        rows(spark, [0, 7]).composed(part)
    with pytest.raises(Exception, match="not in the partition"):
        partition_lines(n.nodes, part.rows).collect()


def test_communities_are_a_map(spark):
    edges = edges_from_rows(spark, [("a", "b", 1.0), ("b", "c", 1.0)])
    frame = lambda *pairs: spark.createDataFrame(list(pairs), "node string, cluster long")
    once, twice = frame(("a", 0), ("b", 0)), frame(("a", 0), ("b", 0), ("a", 0))
    assert api.modularity(edges, once) == api.modularity(edges, twice)
    assert api.leiden(edges, twice, seed=1)[1].count() == 3
    for wrong in (frame(("a", 0), ("a", 1)), frame(("a", -1)), frame(("a", None))):
        with pytest.raises(InvalidCommunityMappingError):
            api.modularity(edges, wrong)


def test_start_and_hierarchy_over_the_size_of_a_task(spark):
    """Components too large for a task, from clusters to start from and below clusters of the hierarchy."""
    n, gamma = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "cust_supp")).kept(), 1.0
    start = Clustering(n.nodes.select(F.col("id").alias("node"), (F.col("id") % 5).alias("cluster")))
    _, found = leiden_clustering(n, start, gamma, seed=2, kernel_rows=800, bin_rows=300)
    assert found.num_nodes() == n.totals["num_nodes"] and scoring.quality(n, found, gamma) >= scoring.quality(n, start, gamma)
    tree = hierarchical_clustering(n, None, gamma, max_cluster_size=20, seed=2, kernel_rows=400, bin_rows=40).cache()
    base = tree.filter("level = 0")
    assert base.count() == n.totals["num_nodes"] == tree.filter("is_final_cluster").count() and tree.agg(F.max("level")).first()[0] >= 1
    above = tree.select(F.col("node").alias("n2"), F.col("cluster").alias("c2"))
    assert tree.filter("level > 0").join(above, (F.col("node") == F.col("n2")) & (F.col("parent_cluster") == F.col("c2")), "left_anti").count() == 0


def test_small_components_stay_exact(spark):
    """A network over the size of a task whose components all fit one is not shrunk."""
    n = Network.from_edges(graph(spark, "/root/testdata/sf0.001", "stars")).kept()
    one, many = (leiden_clustering(n, None, 1.0, seed=1, kernel_rows=k)[1] for k in (engine.KERNEL_ROWS, 200))
    assert listed(one) == listed(many)


def test_hierarchy_rows(spark):
    found = api.clusters_of(api.hierarchical_leiden(edges_from_rows(spark, org()), max_cluster_size=2, seed=1))
    assert len({x.node for x in found if x.level == 0}) == 10 and sum(x.is_final_cluster for x in found) == 10
    assert all(x.parent_cluster is None for x in found if x.level == 0)


def test_edge_files_and_command_line(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("s,t,w\r\n\r\n" + "\r\n".join(f"{a},{b},{w:g}" for a, b, w in ORG))
    bad.write_text("dwayne,nick,10.0\njon\ncarolyn,\nchris,david,\n")
    found = read_edge_file(spark, str(good), skip_first_line=True).orderBy("ord").collect()
    assert [(r.src, r.dst, r.weight) for r in found] == org()
    assert {r.weight for r in read_edge_file(spark, str(good), weight_index=None, skip_first_line=True).collect()} == {1.0}
    with pytest.raises(EdgeFileFormatError):
        read_edge_file(spark, str(bad))
    for text in ("a,b, 1", "a,b,1d", "a,b,0x1", "a,b,"):
        bad.write_text(text)
        with pytest.raises(EdgeFileFormatError):
            read_edge_file(spark, str(bad))
    bad.write_text("a|b|1e3\nb|c|.5\nc|a|-inf\nd|e|NaN")
    assert [str(r.weight) for r in read_edge_file(spark, str(bad), "|").orderBy("ord").collect()] == ["1000.0", "0.5", "-inf", "nan"]
    out = tmp_path / "out"
    assert cli.main([str(good), str(out), "--has-header", "--weight-index", "2", "--seed", "1", "-q", "cpm", "-r", "0.05"], spark) == 0
    assert "cpm" in capsys.readouterr().out
    lines = [x for p in sorted(out.glob("part-*")) for x in p.read_text().split()]
    assert [x.split(",")[0] for x in lines] == ["dwayne", "nick", "jon", "carolyn", "chris", "david", "amber", "nathan", "patrick", "bryan"]
    assert cli.main([str(bad)], spark) == 2


def test_table_function(spark):
    table.register(spark)
    edges_from_rows(spark, org() + [("dwayne", "dwayne", 7.0)]).createOrReplaceTempView("org_edges")
    assert communities(spark.sql("select * from leiden(TABLE(org_edges) WITH SINGLE PARTITION)")) == communities(api.leiden(edges_from_rows(spark, org()), seed=1, iterations=2)[1])


def test_stream_rescores(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("src string, dst string, weight double").option("maxFilesPerTrigger", 1).parquet(str(source))
    found = spark.createDataFrame(list(ONE.items()), "node string, cluster long")
    for i, part in enumerate((org()[:4], org()[4:])):
        spark.createDataFrame(part, "src string, dst string, weight double").coalesce(1).write.mode("append").parquet(str(source))
    q = rescore(stream, found, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).first()
    assert last.batch == 1 and last.quality == pytest.approx(0.489795918, abs=1e-9)
