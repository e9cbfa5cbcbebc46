"""Algorithms against known results on the small graphs."""

import math

import pytest
from conftest import incidence_graph, sets_by_id, values
from pyspark.sql import functions as F

from weft.operators.projection import Projection
from weft.plans import (
    connected_components,
    label_propagation,
    neighbour_counts,
    pagerank,
    pagerank_entropy,
    pagerank_graph,
    pagerank_on_graph,
    random_walk,
    shortest_path,
)
from weft.plans.pagerank import weight_per_member

# Expected results on the small graphs, here and below.
TREE_HOPS = {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3, 9: 4}
CYCLE_HOPS = {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3, 9: 2, 10: 1, 11: 1}


@pytest.mark.parametrize("combine", ["min", "sum"])
def test_shortest_path(tree, cycle, combine):
    done = shortest_path(tree, 10, 1, combine)
    assert values(done.hv) == TREE_HOPS
    assert values(done.he) == {10: 1, 11: 2, 12: 3, 13: 4}
    done = shortest_path(cycle, 10, 1, combine)
    assert values(done.hv) == CYCLE_HOPS
    assert values(done.he) == {12: 1, 13: 2, 14: 3, 15: 3, 16: 2, 17: 1}


def test_shortest_path_min_is_true_distance_where_sum_is_not(spark):
    # Two equally long ways to one hyperedge: adding doubles the distance.
    graph = incidence_graph(spark, [(0, 1), (0, 2), (1, 1), (1, 3), (2, 2), (2, 3), (2, 4)])
    assert values(shortest_path(graph, 10).hv)[4] == 2
    assert values(shortest_path(graph, 10, combine="sum").hv)[4] == 4


def test_unreached_is_infinite(tree):
    done = shortest_path(tree, 1, 1)
    assert values(done.he) == {10: 1, 11: math.inf, 12: math.inf, 13: math.inf}


TREE_WALK = [.150097, .000097, .000194, .150097, .000193, .000096, .000096, .000192, .000096]
CYCLE_WALK = [.150196, .000196, .000195, .150098, .000195, .000098, .000098, .000195, .000195,
              .000195, .000098]


def test_random_walk(spark, tree, cycle):
    for graph, expected in ((tree, TREE_WALK), (cycle, CYCLE_WALK)):
        done = random_walk(graph, 50, [1, 4], 0.15, 1e-4)
        got = values(done.hv)
        assert [got[i + 1] for i in range(len(expected))] == pytest.approx(expected, abs=1e-6)
        assert set(values(done.he).values()) == {0.0}


def test_random_walk_from_a_table_of_starts(spark, tree):
    starts = spark.createDataFrame([(1,), (4,)], "id bigint")
    assert values(random_walk(tree, 3, starts, 0.15, 1e-4).hv) == values(
        random_walk(tree, 3, [1, 4], 0.15, 1e-4).hv
    )


def test_pagerank(papers):
    names = {row.id: row.attr for row in papers.hv.collect()}
    sets = sets_by_id(papers)
    done = pagerank(papers, 5)
    ranks = {names[i]: r for i, r in values(done.hv).items()}
    assert ranks == pytest.approx({"v1": .923115, "v2": 1.325453, "v3": .751432}, abs=1e-6)
    edges = {sets[i]: r for i, r in values(done.he).items()}
    expected = {("v2", "v3"): .942772, ("v1", "v2", "v3"): .702165, ("v1", "v2"): 1.355063}
    assert edges == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("iterations", [0, 1])
def test_pagerank_short_runs(papers, iterations):
    done = pagerank(papers, iterations)
    assert set(values(done.hv).values()) == {1.0}
    assert set(values(done.he).values()) == {0.0}


def test_pagerank_two_iterations(papers):
    names = {row.id: row.attr for row in papers.hv.collect()}
    ranks = {names[i]: r for i, r in values(pagerank(papers, 2).hv).items()}
    assert ranks == pytest.approx({"v1": .858333, "v2": 1.283333, "v3": .858333}, abs=1e-6)


def test_pagerank_entropy(papers):
    sets = sets_by_id(papers)
    done = pagerank_entropy(papers, 5)
    entropy = {sets[i]: v["entropy"] for i, v in values(done.he).items()}
    expected = {("v1", "v2", "v3"): 1.544153, ("v2", "v3"): .944173, ("v1", "v2"): .976780}
    assert entropy == pytest.approx(expected, abs=1e-6)
    ranks = {i: v["rank"] for i, v in values(done.he).items()}
    assert ranks == pytest.approx(values(pagerank(papers, 5).he))


def test_pagerank_graph_weights(papers):
    names = {row.id: row.attr for row in papers.hv.collect()}
    edges = pagerank_graph(papers).e.collect()
    got = {(names[e.src], names[e.dst]): e.attr for e in edges}
    expected = {
        ("v1", "v1"): 11 / 24, ("v1", "v2"): 11 / 24, ("v1", "v3"): 1 / 12,
        ("v2", "v1"): 11 / 36, ("v2", "v2"): 17 / 36, ("v2", "v3"): 2 / 9,
        ("v3", "v1"): 1 / 9, ("v3", "v2"): 4 / 9, ("v3", "v3"): 4 / 9,
    }
    assert got == pytest.approx(expected)


@pytest.mark.parametrize(
    "iterations, expected",
    [(1, (.89375, 1.31875, .7875)), (3, (.922404, 1.325422, .752175))],
)
def test_pagerank_on_graph_listed_and_factored(papers, iterations, expected):
    names = {row.id: row.attr for row in papers.hv.collect()}
    listed = values(pagerank_on_graph(pagerank_graph(papers), iterations).v)
    factored = {r.id: r.rank for r in Projection(papers, weight_per_member).pagerank(iterations).collect()}
    for ranks in (listed, factored):
        by_name = {names[i]: rank for i, rank in ranks.items()}
        assert [by_name[n] for n in ("v1", "v2", "v3")] == pytest.approx(expected, abs=1e-6)


def test_both_pageranks_converge_to_the_same(papers):
    on_graph = values(pagerank_on_graph(pagerank_graph(papers), 12).v)
    assert values(pagerank(papers, 13).hv) == pytest.approx(on_graph, abs=1e-5)
    assert sorted(on_graph.values()) == pytest.approx([.748843, .925599, 1.325558], abs=1e-5)


def test_connected_components(tree, cycle):
    for graph, label in ((tree, 13), (cycle, 17)):
        for compat in (False, True):
            done = connected_components(graph, compat=compat)
            assert set(values(done.hv).values()) | set(values(done.he).values()) == {label}


def test_connected_components_fixpoint_and_separate_parts(spark):
    chain = [(i, j) for i in range(15) for j in (i, i + 1)]
    graph = incidence_graph(spark, chain + [(100, 500), (100, 501)])
    done = connected_components(graph, max_iters=None)
    top = done.hv.agg(F.max("id")).first()[0] + 1
    labels = values(done.hv)
    assert {labels[i] for i in range(16)} == {top + 14}
    assert {labels[500], labels[501]} == {top + 100}
    assert values(connected_components(graph, 10).hv)[0] != top + 14


def test_connected_components_of_a_dual(tree):
    dual = tree.dual()
    done = connected_components(dual)
    assert set(values(done.hv).values()) | set(values(done.he).values()) == {13}
    kept = connected_components(dual, compat=True)
    assert all(label == node for node, label in values(kept.he).items())


def test_isolated_nodes_in_components(spark):
    from weft import HyperGraph

    graph = HyperGraph.from_tables(
        spark.createDataFrame([(0, 0)], "he_id bigint, hv_id bigint"),
        spark.createDataFrame([(0,), (1,)], "id bigint"),
        spark.createDataFrame([(0,), (1,)], "id bigint"),
    )
    done = connected_components(graph)
    assert values(done.hv) == {0: 2, 1: 1}
    assert values(done.he) == {2: 2, 3: 3}
    assert values(connected_components(graph, compat=True).he) == {2: 2, 3: 0}


def test_label_propagation(tree, cycle):
    for iterations in (3, 5):
        done = label_propagation(tree, iterations)
        assert values(done.hv) == {1: 3, 2: 3, 3: 5, 4: 5, 5: 8, 6: 8, 7: 8, 8: 9, 9: 9}
        assert values(done.he) == {10: 3, 11: 5, 12: 8, 13: 9}
    done = label_propagation(cycle, 5)
    assert set(values(done.hv).values()) | set(values(done.he).values()) == {11}


def test_neighbour_counts(tree):
    members = {}
    for row in tree.inc.collect():
        members.setdefault(row.he_id, set()).add(row.hv_id)
    expected = {
        v: len(set().union(*[m for m in members.values() if v in m])) for v in range(1, 10)
    }
    exact = {r.id: r.neighbours for r in neighbour_counts(tree, exact=True).collect()}
    assert exact == expected
    for row in neighbour_counts(tree).collect():
        assert row.low <= expected[row.id] <= row.high


def test_a_long_chain_is_one_component(spark):
    """Forty hyperedges in a row need more rounds than any fixed number would allow."""
    rows = [(i, j) for i in range(40) for j in (i, i + 1)]
    done = connected_components(incidence_graph(spark, rows))
    assert len(set(values(done.hv).values()) | set(values(done.he).values())) == 1
