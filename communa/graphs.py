"""Graphs derived from the star-schema tables, for queries, tests and benchmarks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from communa.operators.ordering import number_rows

#: Name -> SQL for (src, dst, weight), the same text for Spark and other engines.
EDGES = {
    "nation_trade": """select 'n' || cast(s_nationkey as varchar(9)) as src, 'n' || cast(c_nationkey as varchar(9)) as dst, cast(count(*) as double) as weight
        from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2""",
    "cust_supp": """select 'c' || cast(o_custkey as varchar(19)) as src, 's' || cast(l_suppkey as varchar(19)) as dst, cast(count(*) as double) as weight
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
    "supp_part": """select 's' || cast(l_suppkey as varchar(19)) as src, 'p' || cast(l_partkey as varchar(19)) as dst, cast(sum(l_quantity) as double) as weight
        from lineitem group by 1, 2""",
    "order_supp": """select 'o' || cast(l_orderkey as varchar(19)) as src, 's' || cast(l_suppkey as varchar(19)) as dst, cast(count(*) as double) as weight
        from lineitem group by 1, 2""",
    "part_copurchase": """select 'p' || cast(a.l_partkey as varchar(19)) as src, 'p' || cast(b.l_partkey as varchar(19)) as dst, cast(count(*) as double) as weight
        from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2""",
    "user_type": """select 'u' || cast(user_id as varchar(19)) as src, event_type as dst, cast(count(*) as double) as weight from events group by 1, 2""",
    "geo_tree": """select 'n' || cast(n_nationkey as varchar(9)) as src, 'r' || cast(n_regionkey as varchar(9)) as dst, cast(1 as double) as weight from nation
        union all select 'c' || cast(c_custkey as varchar(19)), 'n' || cast(c_nationkey as varchar(9)), cast(1 as double) from customer""",
    "cliques": """select a.n_name as src, b.n_name as dst, cast(1 as double) as weight from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey""",
    "stars": """select 'o' || cast(o_orderkey as varchar(19)) as src, 'c' || cast(o_custkey as varchar(19)) as dst, cast(1 as double) as weight from orders""",
    "clique_pairs": """with n as (select c_custkey as k from customer)
        select 'c' || cast(a.k as varchar(19)) as src, 'c' || cast(b.k as varchar(19)) as dst, cast(1 as double) as weight
        from n a join n b on floor(a.k / 4) = floor(b.k / 4) and a.k < b.k
        union all select 'c' || cast(a.k as varchar(19)), 'c' || cast(a.k + 1 as varchar(19)), cast(1 as double) from n a join n b on b.k = a.k + 1 where a.k % 8 = 3""",
}
_TABLES = ("lineitem", "supplier", "orders", "customer", "events", "nation")
#: Rows of the tables of a graph for each partition of its joins and sums, at most.
PART_ROWS = 250_000


@contextmanager
def parted(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of jobs that run inside have a partition for each PART_ROWS rows at least, so that a task's memory doesn't follow the tables; the session's
    setting is put back."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-rows // PART_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(src, dst, weight, ord), ``ord`` in order of src, dst."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in EDGES[name].replace("\n", " ")}
    text = EDGES[name]
    with parted(spark, sum(f.count() for f in frames.values())):
        return number_rows(spark.sql(_braced(text, frames), **frames), "src", "dst", name="ord")


def _braced(text: str, frames: dict[str, DataFrame]) -> str:
    """Table names as parameters of a query, so that no view is registered in the session."""
    import re

    for t in frames:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return text


def prelude(name: str) -> str:
    """The network of a graph as common table expressions: e (edges with ord), nodes, und (pairs once), loops, adj, nw (node weights)."""
    return f"""with edges as ({EDGES[name]}),
    e as (select *, row_number() over (order by src, dst) - 1 as ord from edges),
    firsts as (select label, min(pos) as pos from (select src as label, 2 * ord as pos from e union all select dst, 2 * ord + 1 from e) t group by label),
    nodes as (select row_number() over (order by pos) - 1 as id, label from firsts),
    und as (select least(a.id, b.id) as s, greatest(a.id, b.id) as d, arg_min(weight, ord) as w from e join nodes a on a.label = src join nodes b on b.label = dst group by 1, 2),
    loops as (select cast(coalesce(sum(w), 0) as double) as v from und where s = d),
    adj as (select s as src, d as dst, w as weight from und where s <> d union all select d, s, w from und where s <> d),
    nw as (select id, label, cast(coalesce(sum(adj.weight), 0) as double) as weight from nodes left join adj on id = src group by 1, 2)"""
