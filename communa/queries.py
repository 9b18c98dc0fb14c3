"""One query for each operator on networks and partitions, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa import api, cli
from communa.functions.gains import approximate_exponent, quality_increment, quality_increment_paper, seeded_uniform
from communa.graphs import graph, prelude
from communa.operators import moves, network as networks, partition as partitions, scoring, transforms
from communa.operators.components import connected_components as components_of
from communa.operators.network import Network
from communa.operators.ordering import number_rows
from communa.operators.partition import Clustering
from communa.plans.engine import leiden_clustering
from communa.plans.hierarchy import final_flags, hierarchical_clustering
from communa.sources import edges as sources
from communa.storage import materialize, owned, remove, scratch, sized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
GAMMA = 0.0009765625


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = owned(sized(f))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def net(spark: SparkSession, sf_dir: str, name: str, use_modularity: bool = True) -> Network:
    return Network.from_edges(graph(spark, sf_dir, name), use_modularity)


# cust_supp's nodes by the last digits of their keys: clusters 0, 2, 4, ... 18, so that odd numbers are empty
BY_DIGIT = "select id as node, 2 * (cast(substr(label, 2) as bigint) % 10) as cluster from nodes"


def by_digit(n: Network) -> Clustering:
    return Clustering(n.nodes.select(F.col("id").alias("node"), (2 * (F.expr("cast(substr(label, 2) as bigint)") % 10)).alias("cluster")))


CS, NT = prelude("cust_supp"), prelude("nation_trade")
CSC = CS + f", c as ({BY_DIGIT})"
REGION = NT + ", c as (select id as node, cast(n_regionkey as bigint) as cluster from nodes join nation on label = 'n' || cast(n_nationkey as varchar))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node label, cluster) of nations."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_regionkey").cast("long").alias("cluster"))


# sources and sinks


@query("select 'c' || cast(o_custkey as varchar) as src, 's' || cast(l_suppkey as varchar) as dst, cast(count(*) as double) as weight from lineitem join orders on l_orderkey = o_orderkey group by 1, 2")
def edge_file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list written as delimited text and read back."""
    path = scratch(spark)
    rows = graph(spark, sf_dir, "cust_supp").orderBy("ord").select(F.concat_ws("|", "src", F.lit("x"), "dst", F.col("weight").cast("string")).alias("line"))
    rows.write.text(path)
    found = materialize(sources.read_edge_file(spark, path, "|", 0, 2, 3).select("src", "dst", "weight"))
    remove(spark, path)
    return found


@query(CSC + " select label || ',' || cast(cluster as varchar) as line, id from c join nodes on id = node")
def partition_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of lines in order of node id, read back with their places."""
    n, path = net(spark, sf_dir, "cust_supp"), scratch(spark)
    sources.write_partition(n.nodes, by_digit(n).rows, path, single=True)
    found = number_rows(spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("place")), "place").select("line", "id")
    found = materialize(found)
    remove(spark, path)
    return found


@query(CSC + " select label as node, cluster from c join nodes on id = node")
def partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    return sources.labeled_partition(n.nodes, by_digit(n).rows).select("node", "cluster")


@query(
    CS + """, given as (select label, cast(substr(label, 2) as bigint) % 7 * 3 as g from nodes where label like 's%'),
    raw as (select id, coalesce(g, (select max(g) + 1 from given) + id) as c from nodes left join given using (label))
    select id as node, dense_rank() over (order by c) - 1 as cluster from raw"""
)
def starting_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    given = n.nodes.filter("label like 's%'").select(F.col("label").alias("node"), F.expr("cast(substr(label, 2) as bigint) % 7 * 3").alias("cluster"))
    return partitions.starting_communities(n.nodes, given.union(spark.createDataFrame([("nobody", 0)], "node string, cluster long"))).rows


# construction


@query(CS + " select src, dst, weight from adj")
def edges_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "cust_supp").adj


@query(prelude("supp_part") + " select id, label from nodes")
def node_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.dictionary(graph(spark, sf_dir, "supp_part"))


@query(NT + " select v as total_self_links_edge_weight from loops")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "nation_trade").self_links()


@query(NT + " select least(a.label, b.label) as a, greatest(a.label, b.label) as b, sum(weight) as weight from e join nodes a on a.label = src join nodes b on b.label = dst group by 1, 2")
def edges_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in that sums repeated pairs."""
    return networks.deduplicated(graph(spark, sf_dir, "nation_trade"), "sum").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")


@query(NT + " select id, weight from nw")
def node_weights_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "nation_trade").nodes.select("id", "weight")


@query(NT + " select id, cast(1 as double) as weight from nw")
def node_weights_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "nation_trade", False).nodes.select("id", "weight")


@query(CS + " select src, dst, weight, row_number() over (partition by src order by dst) - 1 as position from adj")
def neighbors_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.dense_ranks(net(spark, sf_dir, "cust_supp").adj, "src", "dst").withColumnRenamed("rank", "position")


@query(CS + " select a.label as label, id from nodes a where label in ('c1', 's1', 's2') union all select 'nobody', null")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("c1",), ("s1",), ("s2",), ("nobody",)], "label string")
    known = net(spark, sf_dir, "cust_supp")
    return known.ids_for(asked).select("label", "id")


# scans and totals


@query(NT + """ select (select count(*) from nodes) as num_nodes, (select count(*) // 2 from adj) as num_edges, (select cast(sum(weight) as double) from nw) as total_node_weight,
    (select cast(sum(weight) / 2 as double) from adj) as total_edge_weight, (select v from loops) as total_self_links_edge_weight""")
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "nation_trade").summary()


@query(CS + """ select id, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as first, degree
    from (select id, count(src) as degree from nodes left join adj on id = src group by id) t""")
def neighbor_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "cust_supp").neighbor_ranges().select("id", F.col("first").cast("long").alias("first"), F.col("degree").cast("long").alias("degree"))


@query(CS + """ select src, row_number() over (order by src, dst) - 1 as connection_id, dst as id, adj.weight as edge_weight, nw.weight as node_weight from adj join nw on dst = id""")
def neighbor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "cust_supp").neighbor_scan()


@query(prelude("part_copurchase") + " select id, weight as strength from nw")
def node_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir, "part_copurchase").strengths()


# partition algebra


@query(CS + " select id as node, id as cluster from nodes")
def self_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Clustering.self_clusters(net(spark, sf_dir, "cust_supp").nodes).rows


@query(CSC + ", ids as (select unnest(range(19)) as cluster) select ids.cluster, count(node) as n from ids left join c on ids.cluster = c.cluster group by 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_digit(net(spark, sf_dir, "cust_supp")).sizes()


@query(CSC + " select cluster, string_agg(cast(node as varchar), ',' order by node) as members from c group by 1")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_digit(net(spark, sf_dir, "cust_supp")).members()
    return found.select("cluster", F.array_join("members", ",").alias("members"))


@query(CSC + " select node, dense_rank() over (order by cluster) - 1 as cluster from c")
def compact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_digit(net(spark, sf_dir, "cust_supp")).compacted().rows


@query(CSC + " select node, cluster // 2 % 3 as cluster from c")
def compose_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = spark.range(0, 20, 2).select(F.col("id").alias("node"), F.expr("id div 2 % 3").alias("cluster"))
    return by_digit(net(spark, sf_dir, "cust_supp")).composed(Clustering(outer, 3)).rows


@query(CSC + " select node, dense_rank() over (order by cluster, node % 3) - 1 as cluster from c")
def merge_subclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_digit(net(spark, sf_dir, "cust_supp"))
    return c.refined(c.rows.select("node", (F.col("node") % 3).alias("part"))).rows


@query(CSC + " select node, case when node % 5 = 0 then 40 + node % 2 else cluster end as cluster from c")
def update_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_digit(net(spark, sf_dir, "cust_supp"))
    return c.update(c.rows.filter("node % 5 = 0").select("node", (40 + F.col("node") % 2).alias("cluster"))).rows


@query(CSC + " select count(*) as num_nodes, max(cluster) + 1 as next_cluster_id from c")
def partition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_digit(net(spark, sf_dir, "cust_supp"))
    return c.rows.agg(F.count("*").alias("num_nodes"), F.lit(c.next_cluster_id()).cast("long").alias("next_cluster_id"))


@query(CSC + " select node, cluster from c where node in (0, 7)")
def cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_digit(net(spark, sf_dir, "cust_supp"))
    return spark.createDataFrame([(x, c.cluster_at(x)) for x in (0, 7)], "node long, cluster long")


@query(REGION + " select string_agg(cast(node as varchar) || ':' || cast(cluster as varchar), ',' order by node) as clusters from c")
def clustering_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "nation_trade")
    entries = partitions.starting_communities(n.nodes, regions(spark, sf_dir)).as_map().select(F.array_sort(F.map_entries("clusters")).alias("e"))
    return entries.select(F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("clusters"))


@query(CSC + " select node, cluster, row_number() over (order by cluster, node) - 1 as position from c")
def ordered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.number_rows(by_digit(net(spark, sf_dir, "cust_supp")).rows, "cluster", "node", name="position")


@query(CSC + """ select row_number() over (order by cluster, k) - 1 as node, cluster from (select cluster, unnest(range(count(*) % 7 + 1)) as k from c group by cluster) t""")
def induced_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = by_digit(net(spark, sf_dir, "cust_supp")).rows.groupBy("cluster").agg((F.count("*") % 7 + 1).alias("parts"))
    return partitions.induced_initial(counts).rows


SPLIT = prelude("geo_tree") + ", c as (select id as node, case when label like 'c%' then id % 3 else 3 + id % 5 end as cluster from nodes)"


@query(
    SPLIT + """, linked as (select distinct src as node from adj join c a on src = a.node join c b on dst = b.node where a.cluster = b.cluster),
    stray as (select node from c where node not in (select node from linked) and cluster in (select cluster from c group by 1 having count(*) > 1)),
    moved as (select node, (select max(cluster) + 1 from c) + row_number() over (order by node) - 1 as cluster from stray)
    select c.node, coalesce(moved.cluster, c.cluster) as cluster from c left join moved on c.node = moved.node"""
)
def sanity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "geo_tree")
    rows = n.nodes.select(F.col("id").alias("node"), F.expr("case when label like 'c%' then id % 3 else 3 + id % 5 end").alias("cluster"))
    return partitions.sanity_split(n.adj, Clustering(rows)).rows


# subnetworks and quotient


SUB = CSC + ", sub as (select a.cluster, src, dst, weight from adj join c a on src = a.node join c b on dst = b.node where a.cluster = b.cluster)"


@query(SUB + " select cluster, src, dst, weight from sub")
def subnetworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    return transforms.subnetworks(n.adj, by_digit(n))


@query(SUB + " select cluster, src as id, sum(weight) as weight from sub group by 1, 2")
def subnetwork_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    return transforms.subnetwork_nodes(transforms.subnetworks(n.adj, by_digit(n)))


@query(
    CS + """, c as (select id as node, case when id % 100 < 50 then 0 else id % 100 end as cluster from nodes), big as (select cluster from c group by 1 having count(*) >= 100)
    select a.cluster, src, dst, weight from adj join c a on src = a.node join c b on dst = b.node where a.cluster = b.cluster and a.cluster in (select cluster from big)"""
)
def subnetworks_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    rows = n.nodes.select(F.col("id").alias("node"), F.expr("case when id % 100 < 50 then 0 else id % 100 end").alias("cluster"))
    return transforms.subnetworks(n.adj, Clustering(rows), 100)


@query(CSC + " select a.cluster as src, b.cluster as dst, sum(weight) as weight from adj join c a on src = a.node join c b on dst = b.node where a.cluster <> b.cluster group by 1, 2")
def induced_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    return transforms.induced_network(n, by_digit(n)).adj


@query(CSC + ", ids as (select unnest(range(19)) as id) select ids.id, cast(coalesce(sum(weight), 0) as double) as weight from ids left join c on ids.id = cluster left join nw on nw.id = node group by 1")
def induced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    return transforms.induced_network(n, by_digit(n)).nodes.select("id", "weight")


@query(REGION + " select (select v from loops) + sum(weight) as total_self_links_edge_weight from adj join c a on src = a.node join c b on dst = b.node where a.cluster = b.cluster")
def induced_self_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "nation_trade")
    return transforms.induced_network(n, partitions.starting_communities(n.nodes, regions(spark, sf_dir))).self_links()


# scores


@query(NT + " select round(0.5 / (2 * ((select sum(weight) / 2 from adj) + v)), 15) as adjusted_resolution from loops")
def adjusted_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.adjusted_resolution_rows(net(spark, sf_dir, "nation_trade"), 0.5).select(F.round("adjusted_resolution", 15).alias("adjusted_resolution"))


_QUALITY = """, inside as (select coalesce(sum(weight), 0) as x from adj join c a on src = a.node join c b on dst = b.node where a.cluster = b.cluster),
    squares as (select sum(w * w) as x from (select cluster, sum(weight) as w from {nw} join c on id = node group by 1) t), m as (select sum(weight) / 2 as x from adj)
    select round((inside.x - {gamma} * squares.x) / (2 * m.x + v), 9) as quality from inside, squares, m, loops"""


@query(REGION + _QUALITY.format(nw="nw", gamma="1.0 / (2 * (m.x + v))"))
def modularity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.modularity_rows(graph(spark, sf_dir, "nation_trade"), regions(spark, sf_dir)).select(F.round("quality", 9).alias("quality"))


@query(REGION + _QUALITY.format(nw="(select id, 1.0 as weight from nodes) n1", gamma="0.25"))
def cpm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "nation_trade", False)
    found = scoring.quality_rows(n, partitions.starting_communities(n.nodes, regions(spark, sf_dir)), 0.25)
    return found.select(F.round("quality", 9).alias("quality"))


_NEAR = CSC + """, near as (select src as node, cluster, sum(weight) as w from adj join c on dst = c.node group by 1, 2
    union all select node, cluster, 0 from c where (node, cluster) not in (select src, cluster from adj join c on dst = c.node)),
    held as (select cluster, sum(weight) as held from nw join c on id = node group by 1)"""


@query(_NEAR + " select node, near.cluster, cast(w as double) as weight from near")
def neighbor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    return moves.neighbor_clusters(n.adj, by_digit(n).rows)


@query(_NEAR + f" select node, near.cluster, round(w - weight * held * {GAMMA}, 6) as gain from near join held on near.cluster = held.cluster join nw on id = node")
def quality_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _increments(spark, sf_dir, quality_increment)


@query(_NEAR + f" select node, near.cluster, round(w - (weight + held) * {GAMMA}, 6) as gain from near join held on near.cluster = held.cluster join nw on id = node")
def quality_increments_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _increments(spark, sf_dir, quality_increment_paper)


def _increments(spark: SparkSession, sf_dir: str, gain: Callable) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    rows = by_digit(n).rows
    held = moves.cluster_weights(n.nodes, rows).select("cluster", F.col("weight").alias("held"))
    near = moves.neighbor_clusters(n.adj, rows).join(held, "cluster").join(n.nodes.select(F.col("id").alias("node"), F.col("weight").alias("own")), "node")
    return near.select("node", "cluster", F.round(gain(F.col("weight"), F.col("own"), F.col("held"), F.lit(GAMMA)), 6).alias("gain"))


@query("select l_orderkey, l_linenumber, round(case when x < -256 then 0.0 else pow(1 + x / 256, 256) end, 6) as y from (select l_orderkey, l_linenumber, 10 - l_quantity * 8 as x from lineitem) t")
def approx_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = 10 - F.col("l_quantity") * 8
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(approximate_exponent(x), 6).alias("y"))


_GAINS = _NEAR + f""", gains as (select c.node, near.cluster, w - nw.weight * (held - case when near.cluster = c.cluster then nw.weight else 0 end) * {GAMMA} as gain, near.cluster = c.cluster as stay, false as vacant
    from near join c on near.node = c.node join held on near.cluster = held.cluster join nw on nw.id = near.node
    union all select node, -1 - node, 0, false, true from c),
    ranked as (select *, row_number() over (partition by node order by gain desc, stay desc, vacant desc, cluster) as r from gains)"""


@query(_GAINS + " select node, cluster, round(gain, 6) as gain, stay from ranked where r = 1")
def best_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    found = moves.best_moves(moves.move_gains(n.nodes, n.adj, by_digit(n).rows, GAMMA))
    return found.select("node", "cluster", F.round("gain", 6).alias("gain"), "stay")


@query(CSC + " select distinct dst as node from adj join c on dst = c.node where src % 50 = 0 and cluster <> 2 * (src % 10)")
def requeue_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    moved = n.nodes.filter("id % 50 = 0").select(F.col("id").alias("node"), (2 * (F.col("id") % 10)).alias("cluster"))
    return moves.requeued(n.adj, by_digit(n).rows, moved)


_PARTS = SUB + ", p as (select node, node % 4 as part from c), cut as (select cluster, a.part, sum(case when a.part <> b.part then weight else 0 end) as cut from sub join p a on src = a.node join p b on dst = b.node group by 1, 2)"


@query(_PARTS + " select cluster, part, cast(cut as double) as cut from cut")
def cut_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    edges = transforms.subnetworks(n.adj, by_digit(n))
    return moves.cut_weights(edges, n.nodes.select(F.col("id").alias("node"), (F.col("id") % 4).alias("part")))


@query(
    _PARTS + f""", sn as (select cluster, src as id, sum(weight) as weight from sub group by 1, 2), held as (select cluster, part, sum(weight) as held from sn join p on id = node group by 1, 2),
    total as (select cluster, sum(weight) as total from sn group by 1) select cut.cluster, cut.part, cut >= held * (total - held) * {GAMMA} as well from cut join held on cut.cluster = held.cluster and cut.part = held.part
    join total on cut.cluster = total.cluster"""
)
def well_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    edges = transforms.subnetworks(n.adj, by_digit(n))
    return moves.connected_well(edges, transforms.subnetwork_nodes(edges), n.nodes.select(F.col("id").alias("node"), (F.col("id") % 4).alias("part")), GAMMA)


@query(
    _GAINS + """, w as (select node, cluster, pow(1 + gain / 25.6, 256) as w, (node * 37 % 101) / 101.0 as u from gains where gain >= 0),
    sums as (select *, sum(w) over (partition by node order by cluster rows between unbounded preceding and current row) as upto, sum(w) over (partition by node) as total from w)
    select node, case when max(total) < 'infinity' then min(cluster) filter (where upto >= u * total) else arg_max(cluster, gain) end as cluster from (select sums.*, gain from sums join gains using (node, cluster)) t group by 1"""
)
def softmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp")
    gains = moves.move_gains(n.nodes, n.adj, by_digit(n).rows, GAMMA).withColumn("u", (F.col("node") * 37 % 101) / 101.0)
    return moves.softmax_choices(gains.select("node", "cluster", "gain", "u"), 0.1, "u")


@query(CS + " select count(*) as n, count(distinct id) as ids, true as in_range, true as in_order, true as mixed from nodes")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in an order that a seed sets: a permutation, its draws in [0, 1)."""
    drawn = net(spark, sf_dir, "cust_supp").nodes.withColumn("u", seeded_uniform(7, "id"))
    order = networks.number_rows(drawn, "u", "id", name="position")
    following = order.select((F.col("position") - 1).alias("position"), F.col("u").alias("after"))
    both = order.join(following, "position", "left")
    moved = F.sum((F.col("position") != F.col("id")).cast("long")) > 0.9 * F.count("*")
    return both.agg(
        F.count("*").alias("n"), F.countDistinct("position").alias("ids"), (F.min("u") >= 0).__and__(F.max("u") < 1).alias("in_range"),
        (F.count(F.when(F.col("after") < F.col("u"), 1)) == 0).alias("in_order"), moved.alias("mixed"),
    )


@query(prelude("geo_tree") + """, region as (select 'n' || cast(n_nationkey as varchar) as label, n_regionkey as r from nation union all select 'c' || cast(c_custkey as varchar), n_regionkey from customer join nation on c_nationkey = n_nationkey
    union all select 'r' || cast(r_regionkey as varchar), r_regionkey from region)
    select id, min(id) over (partition by r) as component from nodes join region using (label)""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "geo_tree")
    return components_of(n.nodes, n.adj)


# whole algorithms


def canonical(rows: DataFrame) -> DataFrame:
    """(node, community): communities named by their least label."""
    least = rows.groupBy("cluster").agg(F.min("node").alias("community"))
    return rows.join(least, "cluster").select("node", "community")


@query("select n_name as node, min(n_name) over (partition by n_regionkey) as community from nation")
def leiden_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(api.leiden(graph(spark, sf_dir, "cliques"), seed=1, iterations=2)[1])


@query("""with e as (select 'o' || cast(o_orderkey as varchar) as o, 'c' || cast(o_custkey as varchar) as c from orders), n as (select o as node, c from e union select c, c from e)
    select node, min(node) over (partition by c) as community from n""")
def leiden_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(api.leiden(graph(spark, sf_dir, "stars"), seed=1)[1])


_INVARIANTS = " select (select count(*) from nodes) as n_nodes, true as all_covered, true as all_connected, true as beats_singletons, true as ids_contiguous"


def invariants(network: Network, found: Clustering, resolution: float) -> DataFrame:
    """One row: every node in one cluster, clusters connected, numbered without gaps, and better than single nodes."""
    rows = found.rows
    inner = transforms.clustered_edges(network.adj, rows).filter("c1 = c2").select("src", "dst")
    pieces = components_of(network.nodes, inner).join(rows, F.col("id") == F.col("node")).groupBy("cluster").agg(F.countDistinct("component").alias("k")).agg(F.max("k").alias("k"), F.count("*").alias("used"), F.max("cluster").alias("top"))
    better = scoring.quality_rows(network, found, resolution).crossJoin(scoring.quality_rows(network, Clustering.self_clusters(network.nodes), resolution).withColumnRenamed("quality", "alone"))
    covered = network.nodes.join(rows, F.col("id") == F.col("node"), "left").agg(F.count("*").alias("n_nodes"), (F.count("cluster") == F.count("*")).alias("all_covered"))
    one = covered.crossJoin(pieces).crossJoin(better)  # of one row each
    return materialize(one.select("n_nodes", "all_covered", (F.col("k") == 1).alias("all_connected"), (F.col("quality") > F.col("alone")).alias("beats_singletons"), (F.col("used") == F.col("top") + 1).alias("ids_contiguous")))


@query(CS + _INVARIANTS)
def leiden_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "cust_supp").kept()
    return invariants(n, leiden_clustering(n, seed=5)[1], 1.0)


@query(prelude("user_type") + _INVARIANTS)
def leiden_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "user_type", False).kept()
    return invariants(n, leiden_clustering(n, resolution=0.5, seed=5)[1], 0.5)


@query(prelude("user_type") + " select true as at_least_one_trial, (select count(*) from nodes) as n_nodes")
def leiden_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "user_type").kept()
    many, one = (scoring.quality_rows(n, leiden_clustering(n, seed=3, trials=t)[1]) for t in (6, 1))
    both = many.crossJoin(one.withColumnRenamed("quality", "one"))  # of one row each
    return materialize(both.select((F.col("quality") >= F.col("one") - 1e-12).alias("at_least_one_trial"), F.lit(n.nodes.count()).cast("long").alias("n_nodes")))


@query(REGION + " select (select count(*) from nodes) as n_nodes, true as all_covered, true as start_kept_or_better")
def leiden_from_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "nation_trade").kept()
    start = partitions.starting_communities(n.nodes, regions(spark, sf_dir))
    found = leiden_clustering(n, start, seed=2)[1]
    both = scoring.quality_rows(n, found).crossJoin(scoring.quality_rows(n, start).withColumnRenamed("quality", "before"))  # of one row each
    covered = found.rows.count()
    return both.select(F.lit(n.nodes.count()).cast("long").alias("n_nodes"), F.lit(covered).__eq__(F.lit(n.nodes.count())).alias("all_covered"), (F.col("quality") >= F.col("before") - 1e-12).alias("start_kept_or_better"))


# the last pair of cliques may lack some of its eight: then it splits only if it has six or more
@query("""with n as (select c_custkey as k, count(*) over (partition by c_custkey // 8) as size from customer)
    select 'c' || cast(k as varchar) as node, 0 as level, 'c' || cast(k // 8 * 8 as varchar) as community, size < 6 as is_final from n
    union all select 'c' || cast(k as varchar), 1, 'c' || cast(k // 4 * 4 as varchar), true from n where size >= 6""")
def hierarchical_clique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities are named by the member of least key."""
    rows = api.hierarchical_leiden(graph(spark, sf_dir, "clique_pairs"), max_cluster_size=6, seed=4, iterations=2)
    least = rows.groupBy("level", "cluster").agg(F.min_by("node", F.expr("cast(substr(node, 2) as bigint)")).alias("community"))
    return rows.join(least, ["level", "cluster"]).select("node", "level", "community", F.col("is_final_cluster").alias("is_final"))


@query("select count(*) as n, 0 as top_level, true as all_final from (select o_orderkey from orders union all select distinct o_custkey from orders) t")
def hierarchical_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = api.hierarchical_leiden(graph(spark, sf_dir, "stars"), max_cluster_size=4, seed=4)
    return rows.agg(F.count("*").alias("n"), F.max("level").alias("top_level"), F.min("is_final_cluster").alias("all_final"))


@query(prelude("supp_part") + " select (select count(*) from nodes) as n_nodes, true as level0_covers, true as one_final_each, true as children_inside_parents")
def hierarchical_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net(spark, sf_dir, "supp_part").kept()
    rows = materialize(hierarchical_clustering(n, max_cluster_size=100, seed=6))
    base = rows.agg(F.count(F.when(F.col("level") == 0, 1)).alias("n0"), F.sum(F.col("is_final_cluster").cast("int")).alias("finals"), F.countDistinct("node").alias("nodes"))
    above = rows.select(F.col("node").alias("n2"), F.col("cluster").alias("c2"), (F.col("level") + 1).alias("l2"))
    lost = rows.filter("level > 0").join(above, (F.col("node") == F.col("n2")) & (F.col("parent_cluster") == F.col("c2")) & (F.col("level") == F.col("l2")), "left_anti").agg(F.count("*").alias("lost"))
    total = n.nodes.agg(F.count("*").alias("n_nodes"))
    return materialize(total.crossJoin(base).crossJoin(lost).select("n_nodes", (F.col("n0") == F.col("n_nodes")).alias("level0_covers"), ((F.col("finals") == F.col("n_nodes")) & (F.col("nodes") == F.col("n_nodes"))).alias("one_final_each"), (F.col("lost") == 0).alias("children_inside_parents")))


@query(CSC + """, h as (select node, cluster, 0 as level, null as parent_cluster from c union all select node, 100 + cluster * 3 + node % 3, 1, cluster from c where cluster % 4 = 0)
    select node, cluster, level, cast(parent_cluster as bigint) as parent_cluster, not (level = 0 and cluster % 4 = 0) as is_final_cluster from h""")
def hierarchy_final_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_digit(net(spark, sf_dir, "cust_supp")).rows
    top = c.select("node", "cluster", F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent_cluster"))
    return final_flags(top.union(c.filter("cluster % 4 = 0").select("node", (100 + F.col("cluster") * 3 + F.col("node") % 3).alias("cluster"), F.lit(1), "cluster")))


# what has no rows of its own in the queries above


@query("select n_name as src, r_name as dst, cast(n_nationkey as double) as weight, cast(n_nationkey as bigint) as ord from nation join region on n_regionkey = r_regionkey")
def in_memory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples of 25 nations as an edge list."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("n_name", "r_name", "n_nationkey").collect()
    return sources.edges_from_rows(spark, [tuple(r) for r in rows])


@query(prelude("cliques") + ", m as (select count(*) as e from und where s <> d) select count(*) as num_nodes, min(e) as num_edges, true as improved, 0.8 as quality from nodes, m")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports: five cliques of equal size score 1 - 1/5."""
    n = net(spark, sf_dir, "cliques").kept()
    improved, found = leiden_clustering(n, seed=1, iterations=2)
    totals = n.summary().crossJoin(scoring.quality_rows(n, found))  # of one row each
    return totals.select("num_nodes", "num_edges", F.lit(improved).alias("improved"), F.round("quality", 9).alias("quality"))


@query(CS + ", asked as (select unnest(range(0, (select count(*) + 5 from nodes))) as id) select asked.id, label, label is not null as inside from asked left join nodes on nodes.id = asked.id")
def bounds_checked_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all ids and of five beyond the last, which are misses."""
    n = net(spark, sf_dir, "cust_supp")
    found = n.labels_for(spark.range(n.nodes.count() + 5))
    return found.select("id", "label", F.col("label").isNotNull().alias("inside"))


@query(
    CSC + """, gone as (select * from c where cluster < 0) select count(*) as num_nodes, coalesce(max(cluster) + 1, 0) as next_cluster_id, count(distinct cluster) as num_clusters, count(*) as compacted, count(*) as composed,
    count(*) as refined, count(*) as updated, count(*) as members, count(*) as split from gone"""
)
def empty_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of no cluster of a partition, through the algebra of partitions."""
    n = net(spark, sf_dir, "cust_supp")
    whole = by_digit(n)
    c = Clustering(whole.rows.filter("cluster < 0"))
    found = {
        "num_clusters": c.sizes(), "compacted": c.compacted().rows, "composed": c.composed(whole).rows, "refined": c.refined(whole.rows.select("node", F.col("cluster").alias("part"))).rows,
        "updated": c.update(whole.rows).rows, "members": c.members(), "split": partitions.sanity_split(n.adj, c).rows,
    }
    counts = [df.agg(F.count("*").alias(name)) for name, df in found.items()]
    out = c.rows.agg(F.count("*").alias("num_nodes"), F.lit(c.next_cluster_id()).cast("long").alias("next_cluster_id"))
    for one in counts:
        out = out.crossJoin(one)  # of one row each
    return out


@query(CSC + " select node, cluster, cast(40 as bigint) as next_cluster_id from c")
def defined_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and a next id that are taken as they are."""
    c = Clustering.defined(by_digit(net(spark, sf_dir, "cust_supp")).rows, 40)
    return c.rows.withColumn("next_cluster_id", F.lit(c.next_cluster_id()).cast("long"))


@query(CSC + " select count(*) as num_nodes, cast(0 as bigint) as next_cluster_id from c")
def next_id_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_digit(net(spark, sf_dir, "cust_supp")).reset_next_cluster_id()
    return c.rows.agg(F.count("*").alias("num_nodes"), F.lit(c.next_cluster_id()).cast("long").alias("next_cluster_id"))


@query(CSC + " select cluster from (select unnest(range(0, (select max(cluster) + 1 from c))) as cluster) t where cluster not in (select cluster from c)")
def free_cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers below the next id that no node is in."""
    return by_digit(net(spark, sf_dir, "cust_supp")).sizes().filter("n = 0").select("cluster")


@query(CSC + """, inner_ as (select c1.cluster, src as id, sum(weight) as weight from adj join c c1 on c1.node = src join c c2 on c2.node = dst where c1.cluster = c2.cluster group by 1, 2)
    select cluster, id, id as part, weight, sum(weight) over (partition by cluster) as total from inner_""")
def subnetwork_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where refinement starts: each node with edges inside its cluster is a part alone, beside its weight and its cluster's."""
    n = net(spark, sf_dir, "cust_supp")
    nodes = transforms.subnetwork_nodes(transforms.subnetworks(n.adj, by_digit(n)))
    totals = nodes.groupBy("cluster").agg(F.sum("weight").alias("total"))
    return nodes.join(totals, "cluster").select("cluster", "id", F.col("id").alias("part"), "weight", "total")


@query("select n_name as node, cast(0 as bigint) as level, true as at_top, true as is_final, count(*) over (partition by n_regionkey) as members from nation")
def hierarchical_cluster_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of a hierarchy of 25 nodes, by their fields."""
    found = api.clusters_of(api.hierarchical_leiden(graph(spark, sf_dir, "cliques"), max_cluster_size=6, seed=1, iterations=2))
    size = {c: sum(x.cluster == c for x in found) for c in {x.cluster for x in found}}
    rows = [(x.node, x.level, x.parent_cluster is None, x.is_final_cluster, size[x.cluster]) for x in found]
    return spark.createDataFrame(rows, "node string, level long, at_top boolean, is_final boolean, members long")


@query("""select * from (values ('ClusterIndexingError', 'RuntimeError'), ('EmptyNetworkError', 'ValueError'), ('InvalidCommunityMappingError', 'ValueError'), ('InternalNetworkIndexingError', 'RuntimeError'),
    ('ParameterRangeError', 'ValueError')) t(raised, base)""")
def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wrong calls raise."""
    edges, none = graph(spark, sf_dir, "cliques"), spark.createDataFrame([], "src string, dst string, weight double, ord long")
    n = net(spark, sf_dir, "cliques")
    calls = [
        lambda: by_digit(n).cluster_at(-1), lambda: api.leiden(none), lambda: api.modularity(edges, {"FRANCE": -1}), lambda: n.node_weight(-1), lambda: api.leiden(edges, randomness=0.0),
    ]
    rows = []
    for call in calls:
        try:
            call()
        except (RuntimeError, ValueError) as e:
            rows.append((type(e).__name__, "RuntimeError" if isinstance(e, RuntimeError) else "ValueError"))
    return spark.createDataFrame(rows, "raised string, base string")


@query("select n_name as node, min(n_name) over (partition by n_regionkey) as community from nation")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge file through the command line, to the files that it writes."""
    source, target = scratch(spark), scratch(spark)
    edges = graph(spark, sf_dir, "cliques").orderBy("ord")
    edges.select(F.concat_ws("|", "src", "dst", F.col("weight").cast("string"))).coalesce(1).write.text(source)
    code = cli.main([source, target, "-s", "|", "--weight-index", "2", "--seed", "1", "-i", "2"], spark)
    if code:
        raise RuntimeError(f"the command line returned {code}")
    parts = F.split("value", ",")
    found = materialize(spark.read.text(target).select(parts[0].alias("node"), parts[1].cast("long").alias("cluster")))
    remove(spark, source)
    remove(spark, target)
    return canonical(found)
