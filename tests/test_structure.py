"""Model, attribute maps, structural operators and one-mode graphs."""

import math
from dataclasses import replace

import pytest
from conftest import TREE, incidence_graph, written
from pyspark.sql import functions as F

from weft import Fold, Graph, HyperGraph
from weft.functions import entropy_bits
from weft.operators.projection import Projection
from weft.plans import pagerank_graph
from weft.plans.pagerank import weight_per_member


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.fixture(scope="module")
def shop(spark):
    """Vertices 1..4 (4 isolated), hyperedges 5, 6, 7 (7 isolated), a repeated incidence."""
    return written(
        HyperGraph.from_tables(
            table(spark, [(0, 1), (0, 1), (0, 2), (1, 2), (1, 3)], "he_id bigint, hv_id bigint"),
            table(spark, [(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id bigint, attr string"),
            table(spark, [(0, 10), (1, 20), (2, 30)], "id bigint, attr int"),
            validate=True,
        )
    )


def attrs(nodes):
    return {row.id: row.attr for row in nodes.collect()}


def pairs(inc):
    return sorted((row.he_id, row.hv_id) for row in inc.collect())


def test_ids_are_shifted_behind_the_vertices(shop):
    assert {row.orig_id: row.id for row in shop.he.collect()} == {0: 5, 1: 6, 2: 7}
    assert pairs(shop.inc) == [(5, 1), (5, 1), (5, 2), (6, 2), (6, 3)]


def test_validation(spark):
    inc = table(spark, [(0, 1), (0, 9)], "he_id bigint, hv_id bigint")
    hv, he = table(spark, [(1,), (1,)], "id bigint"), table(spark, [(0,)], "id bigint")
    with pytest.raises(ValueError, match="1 incidences name an unknown hv_id; 1 ids of hv_id"):
        HyperGraph.from_tables(inc, hv, he, validate=True)
    assert HyperGraph.from_tables(inc, hv, he).inc.count() == 2


def test_summary_and_nodes(shop):
    assert shop.summary().collect() == [(4, 3, 5)]
    assert shop.nodes().where("role = 'vertex'").count() == 4


def test_degrees_count_copies_and_isolated_nodes(shop):
    degrees = shop.degrees()
    assert attrs(degrees.hv) == {1: 2, 2: 2, 3: 1, 4: 0}
    assert attrs(degrees.he) == {5: 3, 6: 2, 7: 0}
    assert degrees.hv.agg(F.sum("attr")).first() == degrees.he.agg(F.sum("attr")).first()


def test_dual_of_dual_is_the_same(shop):
    dual = shop.dual()
    assert attrs(dual.hv) == attrs(shop.he)
    again = dual.dual()
    assert pairs(again.inc) == pairs(shop.inc) and attrs(again.hv) == attrs(shop.hv)


def test_maps_augment_and_strip(shop):
    mapped = shop.map_vertices(lambda id, a: F.concat(a, id.cast("string")))
    assert attrs(mapped.hv)[3] == "c3"
    assert attrs(shop.map_hyperedges(lambda id, a: a + id).he) == {5: 15, 6: 26, 7: 37}
    augmented = shop.augment(F.lit(0.5), F.lit("e"))
    assert attrs(augmented.hv)[1] == ("a", 0.5) and attrs(augmented.he)[5] == (10, "e")
    assert attrs(augmented.strip().hv) == attrs(shop.hv)


def test_update_only_touches_listed_nodes(spark, shop):
    values = table(spark, [(2, "x"), (3, None)], "id bigint, value string")
    updated = shop.update_vertices(values, lambda attr, value: F.concat_ws("-", attr, value))
    assert attrs(updated.hv) == {1: "a", 2: "b-x", 3: "c", 4: "d"}


@pytest.mark.parametrize("keep, left", [(False, {2, 3}), (True, {2, 3, 4})])
def test_sub_hypergraph(shop, keep, left):
    sub = shop.sub_hypergraph(lambda id, _: id >= 2, lambda _, attr: attr >= 20, keep)
    assert set(attrs(sub.hv)) == left
    assert set(attrs(sub.he)) == ({6, 7} if keep else {6})
    assert pairs(sub.inc) == [(6, 2), (6, 3)]


def test_sub_hypergraph_without_predicates_drops_isolated(shop):
    sub = shop.sub_hypergraph()
    assert set(attrs(sub.hv)) == {1, 2, 3} and set(attrs(sub.he)) == {5, 6}
    assert len(pairs(sub.inc)) == 5


def test_triplets(shop):
    rows = sorted(shop.triplets().collect())
    assert rows[0] == (1, "a", 5, 10) and len(rows) == 5


def test_parquet_round_trip(shop, tmp_path):
    shop.write_parquet(str(tmp_path / "g"))
    back = HyperGraph.read_parquet(shop.hv.sparkSession, str(tmp_path / "g"))
    assert attrs(back.he) == attrs(shop.he) and pairs(back.inc) == pairs(shop.inc)


# -- projection ---------------------------------------------------------------------------


def brute_edges(graph, value, join):
    by_edge, out = {}, {}
    for he, hv in pairs(graph.inc):
        by_edge.setdefault(he, []).append(hv)
    attr = attrs(graph.he)
    for he, members in by_edge.items():
        for a in members:
            for b in members:
                new = value(attr[he])
                out[a, b] = join(out[a, b], new) if (a, b) in out else new
    return out


def edges(graph):
    return {(row.src, row.dst): row.attr for row in graph.e.collect()}


@pytest.mark.parametrize("block", [2000, 1])
def test_to_graph_with_copies_blocks_and_folds(shop, block):
    value = lambda attr: attr
    for combine, join in (
        ("sum", lambda a, b: a + b),
        ("max", max),
        (Fold(lambda a, b: F.greatest(a, b) * 1, group_rows=2), max),
        (lambda a, b: a + b, lambda a, b: a + b),
    ):
        assert edges(shop.to_graph(value, combine, block)) == brute_edges(shop, value, join)
    assert attrs(shop.to_graph(value).v) == attrs(shop.hv)


def test_blocks_cover_every_pair_once(spark):
    graph = incidence_graph(spark, [(0, v) for v in range(40)] + [(1, 3), (1, 4)])
    one = lambda attr: F.lit(1)
    expected = brute_edges(graph, lambda attr: 1, lambda a, b: a + b)
    assert edges(graph.to_graph(one, "sum", block=7)) == expected


def test_out_weights_of_the_factored_projection(papers):
    listed = papers.to_graph(weight_per_member)
    sums = {}
    for (src, _), weight in edges(listed).items():
        sums[src] = sums.get(src, 0) + weight
    factored = {r.id: r.msg for r in Projection(papers, weight_per_member).out_weights().collect()}
    assert factored == pytest.approx(sums)


# -- one-mode graphs ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def roads(spark):
    return Graph(
        table(spark, [(1, 10), (2, 20), (3, 30)], "id bigint, attr int"),
        table(spark, [(1, 2, 2.0), (1, 3, 6.0), (2, 3, 5.0)], "src bigint, dst bigint, attr double"),
    )


def test_graph_operators(roads):
    degree = {(d, r.id): r.degree for d in ("in", "out", "both") for r in roads.degrees(d).collect()}
    assert degree == {
        ("in", 2): 1, ("in", 3): 2, ("out", 1): 2, ("out", 2): 1,
        ("both", 1): 2, ("both", 2): 2, ("both", 3): 2,
    }
    assert edges(roads.normalize()) == {(1, 2): 0.25, (1, 3): 0.75, (2, 3): 1.0}
    triplets = roads.map_triplets(lambda a, w, b: a + b + w)
    assert edges(triplets) == {(1, 2): 32.0, (1, 3): 46.0, (2, 3): 55.0}
    assert edges(roads.map_edges(lambda w: w * 2))[1, 2] == 4.0
    assert attrs(roads.map_vertices(lambda id, a: a + id).v) == {1: 11, 2: 22, 3: 33}
    assert attrs(roads.augment(F.lit(1)).v)[1] == (10, 1)


def test_aggregate_messages(roads):
    to_dst = roads.aggregate_messages("dst", F.col("attr") * F.col("src_attr"), F.sum, ("src",))
    assert {r.id: r.msg for r in to_dst.collect()} == {2: 20.0, 3: 160.0}
    to_src = roads.aggregate_messages("src", F.col("dst_attr"), F.max, ("dst",))
    assert {r.id: r.msg for r in to_src.collect()} == {1: 30, 2: 30}


def test_normalized_rows_add_up_to_one(papers):
    sums = pagerank_graph(papers).e.groupBy("src").agg(F.sum("attr").alias("s")).collect()
    assert [row.s for row in sums] == pytest.approx([1.0] * 3)


@pytest.mark.parametrize("shares, bits", [([1, 1], 1.0), ([0.25, 0.75], 0.8113), ([1, 3], 0.8113), ([0, 5], 0.0)])
def test_entropy(spark, shares, bits):
    rows = spark.createDataFrame([(float(s),) for s in shares], "x double")
    assert rows.agg(entropy_bits(F.col("x"))).first()[0] == pytest.approx(bits, abs=1e-4)
    assert not math.isnan(rows.agg(entropy_bits(F.col("x"))).first()[0])


def test_tree_fixture_matches_the_list(tree):
    assert pairs(tree.inc) == sorted((h + 10, v) for h, v in TREE)


def test_update_refuses_repeated_ids(spark, tree):
    values = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "id bigint, value int")
    with pytest.raises(Exception, match="several values for id 1"):
        tree.update_vertices(values, lambda attr, value: value).hv.collect()


def test_ids_that_do_not_fit_are_refused(spark):
    from weft import HyperGraph

    inc = spark.createDataFrame([((1 << 62) + 5, (1 << 63) - 1)], "he_id bigint, hv_id bigint")
    nodes = lambda c: inc.select(F.col(c).alias("id"))
    with pytest.raises(ValueError, match="do not fit"):
        HyperGraph.from_tables(inc, nodes("hv_id"), nodes("he_id"))


def test_filtered_incidences_are_read_once(spark, tree):
    small = tree.sub_hypergraph(hyperedge=lambda id, attr: attr["card"] <= 3)
    assert all(t._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2 for t in (small.hv, small.he, small.inc))


def test_a_store_by_part(spark, tmp_path):
    """Known to be distinct and placed when read again; a read for some vertices opens only their parts."""
    rows = [(100 + i % 7, i) for i in range(30)]
    graph = replace(incidence_graph(spark, rows), distinct=True).assign_parts("1D-src", 6)
    path = str(tmp_path / "placed")
    graph.write_parquet(path)
    again = HyperGraph.read_parquet(spark, path)
    assert again.distinct and "part" in again.inc.columns
    whole = lambda g: sorted(tuple(r) for r in g.inc.select("he_id", "hv_id", "part").collect())
    assert whole(again) == whole(graph)
    few = HyperGraph.read_parquet(spark, path, spark.createDataFrame([(3,), (3,), (17,), (999,), (None,)], "id bigint"))
    assert whole(few) == [r for r in whole(graph) if r[1] in (3, 17)]
    assert {r.id for r in few.hv.collect()} == {3, 17} and {r.id for r in few.he.collect()} == {r.he_id for r in few.inc.collect()}
    text = few.inc._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text or "PartitionFilters: [part" in text
    none = HyperGraph.read_parquet(spark, path, spark.createDataFrame([], "id bigint"))
    assert none.inc.count() == none.hv.count() == none.he.count() == 0


def test_a_store_without_parts_or_manifest(spark, tmp_path):
    graph = incidence_graph(spark, [(100, 1), (100, 2), (101, 2)])
    graph.write_parquet(str(tmp_path / "plain"))
    few = HyperGraph.read_parquet(spark, str(tmp_path / "plain"), graph.hv.where("id = 1"))
    assert [r.hv_id for r in few.inc.collect()] == [1] and few.he.count() == 1 and not few.distinct
    for name in ("hv", "he", "inc"):
        getattr(graph, name).write.parquet(str(tmp_path / "old" / name))
    assert HyperGraph.read_parquet(spark, str(tmp_path / "old")).inc.count() == 3
