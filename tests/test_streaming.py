import os
import random

import pytest
from pyspark.sql import functions as F

from communa import api
from communa.errors import InvalidCommunityMappingError
from communa.streaming.rescore import rescore

EDGES = "src string, dst string, weight double"


def started(spark, tmp_path, found, resolution=1.0):
    stream = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return rescore(stream, found, *(str(tmp_path / x) for x in ("store", "out", "check")), resolution)


def given(spark, tmp_path, number, edges):
    """Batch files in order of their times."""
    path = tmp_path / "in"
    path.mkdir(exist_ok=True)
    one = tmp_path / f"made{number}"
    spark.createDataFrame(edges, EDGES).coalesce(1).write.parquet(str(one))
    (made,) = one.glob("*.parquet")
    os.utime(made, (1_000_000 + number, 1_000_000 + number))
    made.rename(path / f"{number}.parquet")


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_each_batch_scores_all_edges_so_far(spark, tmp_path):
    """Pairs that come again, turned round and with other weights, loops, nodes alone, and a restart between."""
    rng = random.Random(3)
    names = [f"n{i}" for i in range(30)]
    seen, batches = set(), []
    for _ in range(5):
        now = {}
        for _ in range(40):
            a, b = rng.choice(names), rng.choice(names)
            now.setdefault(tuple(sorted((a, b))), (a, b, float(rng.randrange(1, 9))))
        again = [(b, a, w + 5) for a, b, w in rng.sample(sorted(seen), min(len(seen), 10)) if tuple(sorted((a, b))) not in now]
        batches.append(list(now.values()) + again)
        seen |= set(now.values())
    found = spark.createDataFrame([(x, i % 4) for i, x in enumerate(names[:22])] + [("nobody", 9), (names[0], 0)], "node string, cluster long")
    for i, edges in enumerate(batches[:3]):
        given(spark, tmp_path, i, edges)
    run(started(spark, tmp_path, found, 0.8))
    for i, edges in enumerate(batches[3:], 3):
        given(spark, tmp_path, i, edges)
    run(started(spark, tmp_path, found, 0.8))
    got = {r["batch"]: r["quality"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    so_far = []
    for i, edges in enumerate(batches):
        so_far += edges
        assert got[i] == pytest.approx(api.modularity(so_far, found, 0.8), abs=1e-12)
    assert set(got) == set(range(5)) and sorted(os.listdir(tmp_path / "store")) == ["3", "4"]


def test_work_follows_the_batch(spark, tmp_path):
    """What a batch keeps is a row for each cluster and lone node, however many edges came."""
    found = spark.createDataFrame([(f"n{i}", i % 2) for i in range(200)], "node string, cluster long")
    for k in range(3):
        given(spark, tmp_path, k, [(f"n{i}", f"n{(i * (k + 2) + 1) % 200}", 1.0) for i in range(200)])
    run(started(spark, tmp_path, found))
    kept = spark.read.parquet(str(tmp_path / "store" / "2"))
    assert kept.count() <= 3 and {r["cluster"] for r in kept.collect()} >= {0, 1}


def test_only_loops_and_wrong_mappings(spark, tmp_path):
    found = spark.createDataFrame([("a", 0)], "node string, cluster long")
    given(spark, tmp_path, 0, [("a", "a", 2.0)])
    run(started(spark, tmp_path, found))
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("quality")).first()[0] == api.modularity([("a", "a", 2.0)], found)
    wrong = spark.createDataFrame([("a", 0), ("a", 1)], "node string, cluster long")
    with pytest.raises(InvalidCommunityMappingError):
        started(spark, tmp_path, wrong)
