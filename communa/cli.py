"""Command line: communities of an edge file, written as ``label,cluster`` lines."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from communa.errors import EdgeFileFormatError, ParseCliError
from communa.operators.network import Network
from communa.operators.scoring import quality
from communa.plans.engine import leiden_clustering
from communa.sources.edges import read_edge_file, write_partition
from communa.storage import owned


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ParseCliError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="communa", description=__doc__)
    p.add_argument("edge_list")
    p.add_argument("output")
    p.add_argument("-s", "--separator", default=",")
    p.add_argument("--source-index", type=int, default=0)
    p.add_argument("--target-index", type=int, default=1)
    p.add_argument("--weight-index", type=int, help="weights are 1 without it")
    p.add_argument("--seed", type=int)
    p.add_argument("-i", "--iterations", type=int, default=1)
    p.add_argument("-r", "--resolution", type=float, default=1.0)
    p.add_argument("--randomness", type=float, default=0.01)
    p.add_argument("-q", "--quality", choices=("modularity", "cpm"), default="modularity")
    p.add_argument("--has-header", action="store_true")
    return p


@owned
def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except ParseCliError as e:
        print(f"communa: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("communa").getOrCreate()
    times = [time.perf_counter()]
    try:
        edges = read_edge_file(spark, a.edge_list, a.separator, a.source_index, a.target_index, a.weight_index, a.has_header)
    except EdgeFileFormatError as e:
        print(f"communa: {e}", file=sys.stderr)
        return 1
    network = Network.from_edges(edges, a.quality == "modularity").kept()
    totals = network.totals
    times.append(time.perf_counter())
    try:
        improved, found = leiden_clustering(network, None, a.resolution, a.randomness, a.iterations, a.seed)
    except ValueError as e:
        print(f"communa: {e}", file=sys.stderr)
        return 1
    score = quality(network, found, a.resolution)
    times.append(time.perf_counter())
    write_partition(network.nodes, found.rows, a.output)
    times.append(time.perf_counter())
    load, run, output = (b - t for t, b in zip(times, times[1:], strict=False))
    print(f"Nodes: {totals['num_nodes']}, edges: {totals['num_edges']}")
    print(f"Improved: {improved}")
    print(f"Quality score ({a.quality}): {score}")
    print(f"Seconds to load {load:.3f}, to run {run:.3f}, to write {output:.3f}, in all {times[-1] - times[0]:.3f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
