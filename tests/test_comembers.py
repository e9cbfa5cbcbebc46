"""Exact co-members by pairs and by bitmaps."""

import random

import pytest
from conftest import incidence_graph
from pyspark.sql import functions as F

from weft import HyperGraph
from weft.operators import comembers
from weft.plans import neighbour_counts


def brute(rows, ids):
    members, own = {}, {}
    for h, v in rows:
        members.setdefault(h, set()).add(v)
        own.setdefault(v, set()).add(h)
    return {v: len(set().union(*(members[h] for h in own.get(v, ())))) for v in ids}


def got(frame):
    return {r.id: r.neighbours for r in frame.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    """Hyperedges of 1 to 60 members that overlap, repeated incidences, equal sets, isolated vertices."""
    rng = random.Random(3)
    rows = [(1000 + h, v) for h in range(24) for v in rng.sample(range(150), rng.choice([1, 2, 5, 20, 60]))]
    rows += rows[:30] + [(2000, v) for h, v in rows if h == 1003]
    graph = incidence_graph(spark, rows)
    lone = spark.createDataFrame([(900 + i, None) for i in range(3)], "id bigint, attr int")
    return type(graph)(graph.hv.union(lone), graph.he, graph.inc), rows


@pytest.mark.parametrize("heavy", [0, 4, 20, 1000])
def test_any_limit_gives_the_same(mixed, heavy):
    graph, _ = mixed
    rows = [(r.he_id, r.hv_id) for r in graph.inc.collect()]
    want = brute(rows, [r.id for r in graph.hv.collect()])
    assert got(neighbour_counts(graph, exact=True, heavy=heavy)) == want and 0 in want.values()


def test_large_hyperedges_are_never_paired(mixed, monkeypatch):
    graph, _ = mixed
    seen = []
    pairs = comembers.member_pairs
    monkeypatch.setattr(comembers, "member_pairs", lambda g, *rest: (seen.append(g.inc.groupBy("he_id").count().agg(F.max("count")).first()[0]), pairs(g, *rest))[1])
    neighbour_counts(graph, exact=True, heavy=4).count()
    assert len(seen) == 1 and seen[0] <= 4
    neighbour_counts(graph, exact=True, heavy=0).count()
    assert len(seen) == 1


def test_more_members_than_a_bitmap_holds(spark):
    """Two hyperedges of 50,000 with 30,000 in common, and a pair of which one end is in both."""
    he = spark.createDataFrame([(10**6,), (10**6 + 1,), (10**6 + 2,)], "id bigint").withColumn("attr", F.lit(None).cast("int"))
    big = [spark.range(a, a + 50_000).select(F.lit(10**6 + i).alias("he_id"), F.col("id").alias("hv_id")) for i, a in enumerate((0, 20_000))]
    small = spark.createDataFrame([(10**6 + 2, v) for v in (25_000, 60_000, 80_000, 10)], "he_id bigint, hv_id bigint")
    hv = spark.range(80_001).withColumn("attr", F.lit(None).cast("int"))
    graph = HyperGraph(hv, he, big[0].union(big[1]).union(small))
    found = neighbour_counts(graph, exact=True)
    at = {r.neighbours: (r.n, r.least) for r in found.groupBy("neighbours").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect()}
    # 10 gains 60,000 and 80,000; 60,000 gains 10 and 80,000; 25,000 gains 80,000
    assert at == {50_000: (39_998, 0), 50_002: (2, 10), 70_000: (29_999, 20_000), 70_001: (1, 25_000), 4: (1, 80_000), 0: (10_000, 70_000)}


def test_no_incidences(spark):
    he = spark.createDataFrame([], "id bigint, attr int")
    inc = spark.createDataFrame([], "he_id bigint, hv_id bigint")
    graph = HyperGraph(spark.range(2).withColumn("attr", F.lit(None).cast("int")), he, inc)
    assert got(neighbour_counts(graph, exact=True)) == {0: 0, 1: 0}


def test_sparse_hyperedges_are_counted_by_what_they_share(spark, monkeypatch):
    """Large hyperedges that hardly overlap list no pairs of their members and make no bitmaps of unions."""
    rng = random.Random(5)
    rows = [(5000 + h, v) for v in range(1500) for h in rng.sample(range(12), rng.choice([1, 2, 2, 3]))]
    rows += [(6000, v) for v in range(300)] + [(6001, v) for v in range(300)] + rows[:20]  # many words shared, by few classes
    graph = incidence_graph(spark, rows)
    monkeypatch.setattr(comembers, "member_pairs", None)
    monkeypatch.setattr(comembers, "_united", None)
    rows = [(r.he_id, r.hv_id) for r in graph.inc.collect()]
    want = brute(rows, [r.id for r in graph.hv.collect()])
    assert got(neighbour_counts(graph, exact=True)) == want
    monkeypatch.undo()
    assert got(neighbour_counts(graph, exact=True, heavy=10)) == want


def test_meetings_may_be_too_many(mixed):
    """A limit that what hyperedges share passes ends this way of counting; without one it counts the same."""
    graph, _ = mixed
    links = graph.links().select("he_id", "hv_id")
    assert comembers._by_meetings(links, 1, 2000) is None
    rows = [(r.he_id, r.hv_id) for r in graph.inc.collect()]
    found = comembers._by_meetings(links, 10**9, 2)
    assert {r.id: r._n for r in found.collect()} == brute(rows, {v for _, v in rows})
