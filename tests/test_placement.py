"""Placement strategies against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import hash_part, pair_part, times_prime, wrapping_product
from weft.operators.placement import STRATEGIES, assign_partitions, partition_stats, place

PRIME = 1125899906842597
IDS = [0, 1, -1, 2**63 - 1, -(2**63), 2**50, -27, 123456789012345678, 2**32 - 1, 2**32, -(2**40) + 5]


def wrapped(x):
    return (x * PRIME + 2**63) % 2**64 - 2**63


def h(x, n):
    # The smallest 64-bit number has no absolute value: its plain modulus is taken.
    return wrapped(x) % n if wrapped(x) == -(2**63) else abs(wrapped(x)) % n


def test_product_wraps_like_64_bit_arithmetic(spark):
    rows = spark.createDataFrame([(x,) for x in IDS], "x bigint")
    got = {r.x: (r.p, r.h) for r in rows.select("x", times_prime(F.col("x")).alias("p"), hash_part(F.col("x"), 7).alias("h")).collect()}
    assert got == {x: (wrapped(x), h(x, 7)) for x in IDS}


def test_any_product_wraps_like_64_bit_arithmetic(spark):
    factors = [3, -4611686018427387, 2654435761 * 4294967291, -1, 2**63, 0, 2**64 - 2**32 + 1]
    rows = spark.createDataFrame([(x,) for x in IDS], "x bigint")
    got = rows.select("x", *[wrapping_product(F.col("x"), f).alias(f"f{i}") for i, f in enumerate(factors)]).collect()
    assert [tuple(r) for r in got] == [(x, *((x * f + 2**63) % 2**64 - 2**63 for f in factors)) for x in IDS]


def test_wide_ids_of_many_parts(spark, tmp_path):
    """Part keys whose product with the factor passes 64 bits."""
    from checks.queries import CATALOGUE

    lines = [(h, v) for h, v in zip(range(1, 13), [1, 2000, 2001, 5000, 20_000, 1_200_000] * 2)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(((v * -4611686018427387 + 2**63) % 2**64 - 2**63, (h * 2654435761 * 4294967291 + 2**63) % 2**64 - 2**63) for h, v in lines)
    for name in ("part_default_wide_ids", "part_hybrid_wide_ids"):
        found = CATALOGUE[name](spark, str(tmp_path)).collect()
        assert sorted((r.src, r.dst) for r in found) == want and all(0 <= r.part < 12 for r in found)


@pytest.fixture(scope="module")
def edges(spark):
    generator = random.Random(5)
    rows = [(generator.randint(0, 20) ** 2 // 20, generator.randint(100, 160)) for _ in range(300)]
    return spark.createDataFrame(rows, "src bigint, dst bigint").coalesce(1)


def by_edge(placed):
    found = {}
    for row in placed.collect():
        found.setdefault((row.src, row.dst), set()).add(row.part)
    assert all(len(parts) == 1 for parts in found.values())
    return {edge: parts.pop() for edge, parts in found.items()}


def grid(src, dst, n):
    side = math.ceil(math.sqrt(n))
    if side * side == n:
        return h(src, side) * side + h(dst, side)
    rows = (n + side - 1) // side
    column = h(src, n) // rows
    return column * rows + h(dst, rows if column < side - 1 else n - rows * (side - 1))


@pytest.mark.parametrize("n", [1, 6, 9, 11])
def test_hash_strategies(edges, n):
    expected = {
        "EdgePartition1D": lambda s, d: h(s, n),
        "1D-dst": lambda s, d: h(d, n),
        "2D": lambda s, d: grid(s, d, n),
        "Default": lambda s, d: h(s + d, n),
    }
    for name, rule in expected.items():
        got = by_edge(assign_partitions(edges, name, n))
        assert got == {(s, d): rule(s, d) for s, d in got}


def test_vertex_cuts(spark):
    both = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], "src bigint, dst bigint")
    canonical = by_edge(assign_partitions(both, "CanonicalRandomVertexCut", 97))
    assert canonical[1, 2] == canonical[2, 1] and canonical[3, 4] == canonical[4, 3]
    spread = assign_partitions(spark.range(4000).selectExpr("id AS src", "id % 50 AS dst"), "RandomVertexCut", 8)
    sizes = [r["count"] for r in spread.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("end, name", [(0, "HybridSrc"), (1, "HybridDst")])
def test_hybrid(edges, end, name):
    rows = [(r.src, r.dst) for r in edges.collect()]
    degree = {}
    for row in rows:
        degree[row[end]] = degree.get(row[end], 0) + 1
    cutoff = sorted(degree.values())[len(degree) // 2]
    got = by_edge(assign_partitions(edges, name, 5, cutoff))
    for edge, part in got.items():
        basis = edge[1 - end] if degree[edge[end]] > cutoff else edge[end]
        assert part == wrapped(abs(basis)) % 5
    assert {degree[e[end]] > cutoff for e in got} == {True, False}


@pytest.mark.parametrize("rounds", [1, 3, 16])
@pytest.mark.parametrize("end, name", [(0, "GreedySrc"), (1, "GreedyDst")])
def test_greedy(spark, edges, end, name, rounds):
    """Nodes of a round see the loads of the rounds before it."""
    rows, n = [(r.src, r.dst) for r in edges.collect()], 4
    nodes = sorted({row[end] for row in rows})
    dealt = spark.createDataFrame([(x,) for x in nodes], "id bigint").select("id", pair_part(F.col("id"), F.lit(0), rounds).alias("r"))
    turn = {r.id: r.r for r in dealt.collect()}
    load, expected = [0] * n, {}
    for now in range(rounds):
        placed = [0] * n
        for node in (x for x in nodes if turn[x] == now):
            overlap = [0] * n
            for row in rows:
                if row[end] == node:
                    overlap[h(row[1 - end], n)] += 1
            best = h(node, n)
            for part in range(n):
                if overlap[part] - math.sqrt(load[part]) > overlap[best] - math.sqrt(load[best]):
                    best = part
            placed[best] += sum(overlap)
            expected[node] = best
        load = [a + b for a, b in zip(load, placed)]
    got = by_edge(assign_partitions(edges, name, n, rounds=rounds))
    assert got == {e: expected[e[end]] for e in got}


@pytest.mark.parametrize("name", ["Default", "HybridSrc", "HybridDst", "GreedySrc", "2D"])
def test_extreme_ids(spark, name):
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 1 << 62]
    edges = spark.createDataFrame([(a, b) for a in ids for b in ids], "src bigint, dst bigint")
    assert {r.part for r in assign_partitions(edges, name, 3, threshold=2).collect()} <= {0, 1, 2}


def test_default_wraps(spark):
    ids = [-(1 << 63), (1 << 63) - 1, 5, -(1 << 62)]
    edges = spark.createDataFrame([(a, b) for a in ids for b in ids], "src bigint, dst bigint")
    wrapped = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    assert by_edge(assign_partitions(edges, "Default", 7)) == {(a, b): h(wrapped(a + b), 7) for a in ids for b in ids}


def test_names(edges):
    for name in STRATEGIES:
        assert assign_partitions(edges, name, 3).columns == ["src", "dst", "part"]
    with pytest.raises(ValueError, match="unknown partition strategy"):
        assign_partitions(edges, "Nowhere", 3)


def test_parts_become_spark_partitions(edges, tree):
    placed = place(edges, "1D-src", 5).withColumn("where", F.spark_partition_id())
    assert placed.where("where <> part").count() == 0
    moved = tree.partition_by("HybridDst", 3)
    assert moved.inc.count() == 12 and moved.inc.columns == ["he_id", "hv_id", "part"]


def test_statistics(edges):
    stats = partition_stats(assign_partitions(edges, "1D-src", 5)).first()
    assert stats.edges == 300 and stats.parts_per_src == 1.0
    assert 1.0 < stats.parts_per_dst <= 5.0
