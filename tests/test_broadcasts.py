"""Tables that grow with the graph don't pass for small because their files are well compressed."""

import pytest
from pyspark.sql import functions as F

from communa.operators.network import Network
from communa.plans import engine
from communa.storage import materialize, sized

NODES = 20_000


@pytest.fixture
def threshold(spark):
    """A broadcast of 60 kB: more than the files of a table of NODES rows, less than it takes in memory."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "60k")
    yield
    spark.conf.set(name, before)


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leiden_broadcasts_no_table_by_its_files(spark, threshold, monkeypatch):
    plans = []
    monkeypatch.setattr(engine, "materialize", lambda df: (plans.append(joins(df)), materialize(df))[1])
    pairs = spark.range(NODES).select((F.col("id") - F.col("id") % 4).cast("string").alias("src"), F.col("id").cast("string").alias("dst"), F.lit(1.0).alias("weight"))
    network = Network.from_edges(pairs).kept()
    engine.leiden_clustering(network, seed=1, kernel_rows=10_000, bin_rows=10_000)
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_settings_are_put_back(spark, threshold):
    names = ["spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(c, None) for c in names]
    few, many = materialize(spark.range(10)), materialize(spark.range(NODES))

    @sized
    def inside():
        return [joins(many.join(x.withColumnRenamed("id", "b"), F.col("id") == F.col("b"))) for x in (few, many)]

    small, large = inside()
    assert "BroadcastHashJoin" in small and "SortMergeJoin" in large
    assert [spark.conf.get(c, None) for c in names] == before
