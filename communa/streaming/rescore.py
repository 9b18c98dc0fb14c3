"""Scores of a fixed partition as its edges arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from communa.operators.partition import checked_communities
from communa.operators.scoring import nan_divide
from communa.storage import hold, materialize, remove

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A cluster, or a node that is alone; both are null for the row of the loops.
_KEY = ["cluster", "alone"]
_SUMS = ["inside", "weight", "loops"]


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """State of streams that start inside is kept by RocksDB, since pairs may be more than memory holds; the session's setting is put back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def first_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a <= b, of a stream of edges (src, dst, weight): each unordered pair once, as it comes first. Of weights that come with one
    batch for one pair any one counts."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("weight")).dropDuplicates(["a", "b"])


def cluster_sums(pairs: DataFrame, given: DataFrame) -> DataFrame:
    """(cluster, alone, inside, weight, loops): what pairs (a, b, weight) add to each cluster of given (label, cluster), or node that has none: the weight
    of both directions inside it, that of its ends, and, in one row, that of the loops."""
    ends = [given.select(F.col("label").alias(end), F.col("cluster").alias(f"cluster_{end}")) for end in ("a", "b")]
    placed = pairs.filter("a <> b").join(ends[0], "a", "left").join(ends[1], "b", "left")
    keys = [F.struct(F.col(f"cluster_{end}").alias("cluster"), F.when(F.col(f"cluster_{end}").isNull(), F.col(end)).alias("alone")) for end in ("a", "b")]
    inside = F.when(F.col("cluster_a") == F.col("cluster_b"), F.col("weight")).otherwise(0.0)
    rows = placed.select(F.explode(F.array(*keys)).alias("key"), inside.alias("inside"), "weight").select("key.*", "inside", "weight", F.lit(0.0).alias("loops"))
    null = F.lit(None)
    loops = pairs.filter("a = b").select(null.cast("long").alias("cluster"), null.cast("string").alias("alone"), F.lit(0.0).alias("inside"), F.lit(0.0).alias("weight"), F.col("weight").alias("loops"))
    return _summed(rows.union(loops))


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _SUMS])


def quality_of(sums: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (quality): modularity from rows of :func:`cluster_sums`; NaN for no weight."""
    one = sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in _SUMS], F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("squares"))
    gamma = nan_divide(F.lit(float(resolution)), F.col("weight") + 2 * F.col("loops"))
    return one.select(nan_divide(F.col("inside") - gamma * F.col("squares"), F.col("weight") + F.col("loops")).alias("quality"))


def rescore(edges: DataFrame, communities: DataFrame, store: str, output: str, checkpoint: str, resolution: float = 1.0) -> StreamingQuery:
    """Start a query over a stream of edges (src, dst, weight): each batch appends (batch, quality), the modularity of ``communities`` (node,
    cluster) over all edges so far, under ``output``. Nodes without a community are alone.

    The work of a batch follows its edges and the number of clusters, not the edges before it: which pairs came is the stream's state, and the sums for each
    cluster are kept under ``store``, those of the last two batches, so that a batch that is run again starts from the one before it. It then replaces what it wrote.
    A mapping that gives a label two clusters, or a null or negative one, raises InvalidCommunityMappingError here."""
    given = hold(materialize(checked_communities(communities).select(F.col("node").alias("label"), "cluster")))

    def score(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = cluster_sums(batch, given)
        if number:
            sums = _summed(sums.union(spark.read.schema(sums.schema).parquet(f"{store}/{number - 1}")))
        sums.write.mode("overwrite").parquet(f"{store}/{number}")
        found = quality_of(spark.read.schema(sums.schema).parquet(f"{store}/{number}"), resolution)
        found.select(F.lit(number).cast("long").alias("batch"), "quality").write.mode("overwrite").parquet(f"{output}/batch={number}")
        if number > 1:
            remove(spark, f"{store}/{number - 2}")

    with _on_disk(edges.sparkSession):
        return first_pairs(edges).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).start()
