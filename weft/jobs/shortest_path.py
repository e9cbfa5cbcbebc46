"""Batch job: load an incidence CSV, place it, run shortest path several times, time it.

spark-submit shortest_path.py INPUT CARDINALITY STRATEGY PARTS THRESHOLD ITERATIONS RUNS SOURCE

CARDINALITY ``n > 0`` keeps hyperedges of at most n members, ``n <= 0`` those of at
least ``-n``. STRATEGY is a name of :data:`weft.operators.placement.STRATEGIES`.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from weft.plans import shortest_path
from weft.sources import read_csv
from weft.sources.incidence import cardinality_bounds


def run(
    spark: SparkSession,
    path: str,
    cardinality: int,
    strategy: str,
    parts: int,
    threshold: int,
    iterations: int,
    runs: int,
    source: int,
) -> DataFrame:
    """``(run, ms, copies, messages)``: run 0 is loading, placing and laying out by part, the
    others one shortest path each on that layout. ``copies`` and ``messages`` are what the
    placement makes travel in a run, counted once in a run of its own that is not timed."""
    times = []

    def clock(number: int, work):
        start = time.perf_counter()
        found = work()
        times.append((number, round(1000 * (time.perf_counter() - start))))
        return found

    loaded = read_csv(spark, path, **cardinality_bounds(cardinality))
    graph = clock(0, lambda: loaded.assign_parts(strategy, parts, threshold).prepare())
    try:
        for number in range(1, runs + 1):
            clock(number, lambda: shortest_path(graph, iterations, source))
        traffic: list[tuple[int, int, int]] = []
        if runs > 0:
            shortest_path(graph, iterations, source, traffic=traffic)
    finally:
        graph.release()
    sums = [sum(t[i] for t in traffic) for i in (1, 2)]
    rows = [(number, ms, *(sums if number else (None, None))) for number, ms in times]
    return spark.createDataFrame(rows, "run int, ms bigint, copies bigint, messages bigint")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("path")
    parser.add_argument("cardinality", type=int)
    parser.add_argument("strategy")
    for name in ("parts", "threshold", "iterations", "runs", "source"):
        parser.add_argument(name, type=int)
    arguments = parser.parse_args()
    spark = SparkSession.builder.appName("shortest-path").getOrCreate()
    try:
        run(spark, **vars(arguments)).orderBy("run").show(truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
