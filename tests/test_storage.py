import os
import re

import pytest
from pyspark.sql import functions as F

from communa import api
from communa.queries import ORACLE, QUERIES
from communa.storage import materialize, owned, release, scope, shared_dir, tables_of

SF = "/root/testdata/sf0.001"


def held(spark):
    """Names of the written tables in the shared folder."""
    return {x for x in os.listdir(re.sub("^file:", "", shared_dir(spark))) if x.startswith("communa-")}


def test_scope_keeps_what_the_result_reads(spark):
    @owned
    def inner(n):
        materialize(spark.range(n))
        return materialize(spark.range(n)), "other"

    @owned
    def outer():
        (a, _), (b, _) = inner(3), inner(4)
        return a.union(materialize(spark.range(1))), b.count()

    before = held(spark)
    found, n = outer()
    assert n == 4 and found.count() == 4
    assert held(spark) - before == tables_of(found) and len(tables_of(found)) == 2
    release(found, spark)
    assert held(spark) == before


def test_scope_of_an_error_keeps_nothing(spark):
    before = held(spark)
    with pytest.raises(ZeroDivisionError), scope():
        materialize(spark.range(3))
        raise ZeroDivisionError
    assert held(spark) == before


def test_tables_of_the_caller_stay(spark):
    given = materialize(spark.range(5))
    assert owned(lambda: given.filter(F.col("id") > 1))().count() == 3 and tables_of(given) <= held(spark)
    release(given, spark)


@pytest.mark.parametrize("name", ["network_summary", "leiden_modularity", "hierarchical_leiden", "hierarchical_clique_pairs", "leiden_trials", "command_line", "connected_components", "sanity_split"])
def test_queries_leave_what_they_read(spark, name):
    """A query leaves those tables alone that its result reads, which can be read, and released."""
    assert name in ORACLE
    before = held(spark)
    found = QUERIES[name](spark, SF)
    assert held(spark) - before == tables_of(found)
    found.collect()
    release(found, spark)
    assert held(spark) == before


def test_calls_that_return_numbers_leave_nothing(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 2.0)], "src string, dst string, weight double")
    before = held(spark)
    score = api.modularity(edges, {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1})
    assert score == score and held(spark) == before
    quality, found = api.leiden(edges, seed=1)
    assert quality > 0 and held(spark) - before == tables_of(found) and found.count() == 5
    release(found, spark)
    assert held(spark) == before
