"""Assigning edges to partitions: by hash, by grid, by degree, or greedily."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import hash_part, pair_part, times_prime, wrapping_abs, wrapping_sum
from weft.operators.skew import apart
from weft.session import cut

# Fixed value: degree above which the hybrid strategies scatter a node's edges.
DEGREE_CUTOFF = 70

#: Rounds in which the greedy strategies place nodes by default.
GREEDY_ROUNDS = 16


def _grid(src: Column, dst: Column, n: int) -> Column:
    """Grid of ceil(sqrt n) columns chosen by source, rows chosen by destination.

    When ``n`` is no square the last column is shorter.
    """
    side = math.isqrt(n - 1) + 1
    if side * side == n:
        return hash_part(src, side) * side + hash_part(dst, side)
    rows = -(-n // side)
    last = n - rows * (side - 1)
    column = F.floor(hash_part(src, n) / rows).cast("int")
    height = F.when(column < side - 1, F.lit(rows)).otherwise(F.lit(last))
    return column * rows + hash_part(dst, height)


def _hashed(strategy: str, n: int) -> Column:
    src, dst = F.col("src"), F.col("dst")
    return {
        "1d-src": lambda: hash_part(src, n),
        "1d-dst": lambda: hash_part(dst, n),
        "2d": lambda: _grid(src, dst, n),
        "random": lambda: pair_part(src, dst, n),
        "canonical": lambda: pair_part(F.least(src, dst), F.greatest(src, dst), n),
        "default": lambda: hash_part(wrapping_sum(src, dst), n),
    }[strategy]().cast("int")


def _hybrid(edges: DataFrame, key: str, n: int, threshold: int) -> DataFrame:
    """Edges of a node go together by its own hash, unless its degree exceeds the threshold.

    The hash multiplies the absolute id, so the product may be negative; the partition
    number is its non-negative modulus. Only the nodes above the threshold are joined.
    """
    other = "dst" if key == "src" else "src"
    busy = edges.groupBy(key).agg(F.count("*").alias("_d")).where(F.col("_d") > threshold)
    marked = edges.join(apart(busy.select(key, F.lit(True).alias("_busy"))), key, "left")
    basis = F.when(F.col("_busy"), F.col(other)).otherwise(F.col(key))
    part = F.pmod(times_prime(wrapping_abs(basis)), F.lit(n)).cast("int")
    return marked.withColumn("part", part).drop("_busy")


def _greedy(edges: DataFrame, key: str, n: int, rounds: int) -> DataFrame:
    """Edges of a node move together, to where its neighbours hash but not to full partitions.

    Nodes are dealt by hash into ``rounds`` rounds. In a round every node goes to the
    partition with the largest ``overlap - sqrt(load)``, the load being the edges placed in
    earlier rounds, starting from its own hash and moving only for a strictly better one,
    lowest number first. A round's loads are ``n`` numbers from one aggregate over a row
    per node; the rule is the same at every size of the data.
    """
    other = "dst" if key == "src" else "src"
    counts = (
        edges.groupBy(F.col(key).alias("id"), hash_part(F.col(other), n).alias("bucket"))
        .agg(F.count("*").cast("double").alias("edges"))
    )
    overlap = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda part: F.coalesce(F.try_element_at(F.col("found"), part), F.lit(0.0)),
    )
    nodes = cut(
        counts.groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "edges"))).alias("found"), F.sum("edges").alias("edges"))
        .select("id", "edges", hash_part(F.col("id"), n).alias("home"), pair_part(F.col("id"), F.lit(0), rounds).alias("round"), overlap.alias("overlap"))
    )

    def chosen(loads: Column) -> Column:
        score = F.zip_with("overlap", loads, lambda o, load: o - F.sqrt(load))
        best = F.element_at(
            F.transform(F.array(score), lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("part"), F.array_max(s).alias("top"), s.alias("s"))), 1
        )
        better = best["top"] > F.element_at(best["s"], F.col("home") + 1)
        return F.when(better, best["part"]).otherwise(F.col("home"))

    load, loads = [0.0] * n, []
    for number in range(rounds):
        loads.append(F.array(*map(F.lit, load)))
        if number + 1 < rounds:
            placed = nodes.where(F.col("round") == number).groupBy(chosen(loads[-1]).alias("part")).agg(F.sum("edges").alias("edges"))
            for part, edges_there in placed.collect():  # at most n rows
                load[part] += edges_there
    part = chosen(F.element_at(F.array(*loads), F.col("round") + 1)).alias("part")
    return edges.join(apart(nodes.select(F.col("id").alias(key), part)), key)


# Names accepted for each strategy: the short ones and the long ones.
STRATEGIES = {
    "1D-src": "1d-src",
    "EdgePartition1D": "1d-src",
    "1D-dst": "1d-dst",
    "EdgePartition1DByDst": "1d-dst",
    "2D": "2d",
    "EdgePartition2D": "2d",
    "RandomVertexCut": "random",
    "CanonicalRandomVertexCut": "canonical",
    "Default": "default",
    "HybridSrc": "hybrid-src",
    "HybridDst": "hybrid-dst",
    "GreedySrc": "greedy-src",
    "GreedyDst": "greedy-dst",
}


def assign_partitions(
    edges: DataFrame, strategy: str, n: int, threshold: int = DEGREE_CUTOFF, rounds: int = GREEDY_ROUNDS
) -> DataFrame:
    """``edges(src, dst, ...)`` plus ``part`` in ``0..n-1``; an unknown strategy raises.

    ``threshold`` is for the hybrid strategies, ``rounds`` for the greedy ones.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown partition strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    kind = STRATEGIES[strategy]
    if kind.startswith("hybrid"):
        placed = _hybrid(edges, kind[-3:], n, threshold)
    elif kind.startswith("greedy"):
        placed = _greedy(edges, kind[-3:], n, rounds)
    else:
        placed = edges.withColumn("part", _hashed(kind, n))
    return placed.select(*edges.columns, "part")


def settle(placed: DataFrame, n: int) -> DataFrame:
    """Move each row to the Spark partition its ``part`` names."""
    return placed.repartitionById(n, F.col("part"))


def place(edges: DataFrame, strategy: str, n: int, threshold: int = DEGREE_CUTOFF) -> DataFrame:
    return settle(assign_partitions(edges, strategy, n, threshold), n)


def partition_stats(placed: DataFrame) -> DataFrame:
    """Quality of a placement, one row: edges, parts in use, largest part, and in how many
    parts a source / a destination appears on average."""
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    overall = sizes.agg(
        F.sum("n").alias("edges"),
        F.count("*").cast("bigint").alias("parts_used"),
        F.max("n").alias("largest_part"),
    )

    def spread(key: str) -> DataFrame:
        per_node = placed.select(key, "part").distinct().groupBy(key).agg(F.count("*").alias("n"))
        return per_node.agg(F.avg("n").alias(f"parts_per_{key}"))

    # Three one-row results side by side.
    one = F.lit(1).alias("_one")
    rows = overall.select("*", one)
    for key in ("src", "dst"):
        rows = rows.join(spread(key).select("*", one), "_one")
    return rows.drop("_one")
