"""Leiden as a table function of SQL, for graphs that fit one task: ``select * from leiden(TABLE(edges) WITH SINGLE PARTITION)``; with
``PARTITION BY`` each partition is a graph of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from communa.plans import kernel

SEED, RANDOMNESS, ITERATIONS = 1, 0.001, 2


class LeidenTable:
    """Rows with src, dst and weight -> (node, cluster), by modularity with a resolution of 1; a pair's first weight counts."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.weights: dict[tuple[int, int], float] = {}

    def eval(self, row: Row):
        a, b = (self.ids.setdefault(row[c], len(self.ids)) for c in ("src", "dst"))
        self.weights.setdefault((min(a, b), max(a, b)), float(row["weight"]))

    def terminate(self):
        n = len(self.ids)
        if not n:
            return
        ends = np.array([k for k in self.weights], np.int64).reshape(-1, 2)
        weight = np.array(list(self.weights.values()))
        loop = ends[:, 0] == ends[:, 1]
        total = weight.sum()
        a, b, w = ends[~loop, 0], ends[~loop, 1], weight[~loop]
        strength = np.bincount(a, w, n) + np.bincount(b, w, n)
        g = kernel.Graph.of(n, np.r_[a, b], np.r_[b, a], np.r_[w, w], strength)
        gamma = 1 / (2 * total) if total > 0 else 0.0
        found, _ = kernel.leiden(g, np.arange(n), gamma, RANDOMNESS, ITERATIONS, True, np.random.default_rng(SEED))
        seen: dict[int, int] = {}
        for label, i in self.ids.items():
            yield label, seen.setdefault(int(found[i]), len(seen))


def register(spark: SparkSession, name: str = "leiden") -> None:
    spark.udtf.register(name, udtf(LeidenTable, returnType="node string, cluster int"))
