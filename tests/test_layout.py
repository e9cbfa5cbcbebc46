"""Prepared incidences and change-only node state."""

import os
import random

import pytest
from conftest import CYCLE, incidence_graph, values
from pyspark.sql import functions as F

from weft import AllExcept, Only, Program, Send, Step
from weft.operators import layout, skew
from weft.operators.contraction import component_roots
from weft.plans import connected_components, estimates, neighbour_counts, neighbour_registers, pagerank, shortest_path
from weft.session import checkpoint_folder


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chains(spark):
    """Chains of several lengths, a busy middle, repeated incidences and isolated nodes."""
    rows = [(h, v) for h in range(18) if h % 6 for v in (h, h + 1)] + [(50, v) for v in range(0, 18, 5)] + [(3, 3)] * 4
    graph = incidence_graph(spark, rows)
    lone = spark.createDataFrame([(900 + i, None) for i in range(5)], "id bigint, attr int")
    return type(graph)(graph.hv.union(lone), graph.he, graph.inc)


def runs(graph):
    sized = graph.map_hyperedges(lambda id, _: F.struct(F.lit(2).alias("card"), (1 + id % 3).cast("int").alias("weight")))
    return [values(x) for done in (shortest_path(graph, None, 4), pagerank(sized, 3)) for x in (done.hv, done.he)]


def test_layers_change_no_result(chains, monkeypatch):
    """Written whole, and as layers, merged at once."""
    hops = lambda: [values(x) for done in [shortest_path(chains, 7, 4)] for x in (done.hv, done.he)]
    want = hops()
    merges = []
    merge = layout.NodeState._merge
    monkeypatch.setattr(layout.NodeState, "_merge", lambda self: (merges.append(len(self.layers)), merge(self))[1])
    monkeypatch.setattr(layout, "WHOLE_ROWS", -1)
    monkeypatch.setattr(layout, "MOST_LAYERS", 1)
    assert hops() == want and merges


def test_a_half_step_writes_its_frontier(chains, monkeypatch):
    monkeypatch.setattr(layout, "WHOLE_ROWS", -1)
    written = []
    push = layout.NodeState.push

    def counted(self, rows):
        table = push(self, rows)
        written.append(table.count())
        return table

    monkeypatch.setattr(layout.NodeState, "push", counted)
    trace, frontier = [], []
    near = Program(lambda ss, id, attr, msg: Step(F.least(attr, msg), [Send(F.least(attr, msg), when=(id == 4) if ss == 0 else msg < attr)]), "min")
    flood = Program(lambda ss, id, attr, msg: Step(F.least(attr, msg), [Send(F.least(attr, msg) + 1, when=msg < attr)]), "min")
    far = F.lit(1000).cast("bigint")
    start = chains.map_vertices(lambda id, _: F.when(id == 4, F.lit(0).cast("bigint")).otherwise(far)).map_hyperedges(lambda *_: far)
    start.compute(None, far, near, flood, trace, frontier)
    assert written == trace == [f[1] for f in frontier] and len(trace) > 4
    assert [f[0] for f in frontier] == list(range(len(trace))) and frontier[-1][2] == 0
    assert max(trace) < chains.hv.count() / 2


def test_prepared_incidences_stay_where_they_are(spark, chains):
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    graph = chains.prepare()
    assert graph.prepare() is graph
    assert graph.map_vertices(lambda id, _: id).dual().dual().layout.lanes == graph.layout.lanes
    laid_out = []
    original = layout.Layout.of
    try:
        layout.Layout.of = staticmethod(lambda g: (laid_out.append(g), original(g))[1])
        for got, expected in zip(runs(graph), runs(chains)):
            assert got == pytest.approx(expected)
        assert len(laid_out) == 2  # those on the graph that is not prepared
    finally:
        layout.Layout.of = staticmethod(original)
    lane = graph.layout.lanes["he"]
    loop = layout.loop_session(spark, graph.layout.parts)
    senders = layout.NodeState(graph.hv, graph.layout.parts, loop)
    joined = plan(lane.join(senders.base.select(F.col("id").alias("src_id"), "attr")))
    assert "Exchange" not in joined and "Sort " not in joined and "Bucketed: true" in joined
    assert "Exchange" not in plan(graph.links().groupBy("he_id").agg(F.sum("copies")))
    senders.release()
    graph.release()
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert left.isdisjoint({"links", "nodes"})


def test_settings_of_the_session_stay(spark, chains):
    before = dict(spark.conf.getAll)
    seen = []

    def program(ss, id, attr, msg):
        seen.append(spark.conf.get("spark.sql.adaptive.enabled"))
        return Step(attr, [Send(F.lit(1))])

    chains.compute(2, F.lit(0), Program(program, "sum"), Program(program, "sum"))
    assert dict(spark.conf.getAll) == before and set(seen) == {"true"}


def test_loops_run_side_by_side(spark):
    from concurrent.futures import ThreadPoolExecutor

    graph = incidence_graph(spark, CYCLE).prepare()
    want = values(shortest_path(graph, None, 1).hv)
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: values(shortest_path(graph, None, 1).hv), range(2)))
    assert found == [want] * 2
    graph.release()


def test_long_chains_take_few_jobs(spark):
    links = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b").union(spark.range(20_000, 20_003).selectExpr("id AS a", "20000 AS b"))
    trace = []
    found = component_roots(links.repartition(3), trace)
    assert len(trace) <= 20
    got = {(r.root, r.n) for r in found.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert got == {(10_000, 10_001), (20_002, 3)}
    assert component_roots(links.where("false")).count() == 0


def test_rounds_do_not_multiply_estimated_sizes(spark):
    """The size that the planner sees is that of the files, not a product over all rounds before."""
    ids = random.Random(7).sample(range(10_000), 2_000)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])], "a bigint, b bigint")
    trace = []
    found = component_roots(links, trace)
    assert trace.count("hook") >= 3 and {r.root for r in found.collect()} == {max(ids)}
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**6


def test_contraction_equals_flooding(spark, chains):
    dice = random.Random(4)
    rows = [(dice.randrange(60), dice.randrange(70)) for _ in range(75)]
    for graph in (chains, incidence_graph(spark, rows)):
        done, flooded = connected_components(graph), connected_components(graph, 60)
        assert values(done.hv) == values(flooded.hv) and values(done.he) == values(flooded.he)


def test_recipients_from_tables(spark):
    graph = incidence_graph(spark, CYCLE)
    low = graph.he.agg(F.min("id")).first()[0]
    links = {(r.hv_id, r.he_id) for r in graph.inc.collect()}
    pairs = [(1, low), (1, low), (2, low + 5), (9, low + 1), (None, low), (3, None)]
    named = spark.createDataFrame(pairs, "sender bigint, receiver bigint")
    alone = spark.createDataFrame([(low,), (low,), (low + 2,), (None,)], "receiver bigint")

    def heard(*sends):
        start = graph.map_hyperedges(lambda *_: F.lit(0).cast("bigint"))
        program = Program(lambda ss, id, attr, msg: Step(sends=[Send(id, to) for to in sends]), "sum")
        done = start.compute(1, F.lit(0), program, Program(lambda ss, id, attr, msg: Step(msg), "sum"))
        return {r.id: r.attr for r in done.he.collect()}

    def want(*keep):
        return {h: sum(v for v, x in links for k in keep if x == h and k(v, x)) for h in range(low, low + 6)}

    in_pairs, in_alone = lambda v, h: (v, h) in pairs, lambda v, h: h in (low, low + 2)
    assert heard(Only(named)) == want(in_pairs)
    assert heard(AllExcept(named)) == want(lambda v, h: not in_pairs(v, h))
    assert heard(Only(alone)) == want(in_alone)
    assert heard(AllExcept(alone), Only(named), Only([low + 1])) == want(lambda v, h: not in_alone(v, h), in_pairs, lambda v, h: h == low + 1)
    with pytest.raises(ValueError, match="receiver"):
        heard(Only(alone.withColumnRenamed("receiver", "other")))


def test_registers_give_good_estimates(spark):
    rows = [(h, v) for h in range(3) for v in range(h * 1500, h * 1500 + 3000)] + [(9, 9000), (9, 9001)]
    graph = incidence_graph(spark, rows)
    found = {r.id: r.estimate for r in estimates(neighbour_registers(graph)).collect()}
    exact = {r.id: r.neighbours for r in neighbour_counts(graph, exact=True).collect()}
    assert found.keys() == exact.keys()
    assert all(abs(found[i] - n) <= max(1, 0.06 * n) for i, n in exact.items())


@pytest.mark.parametrize("strategy, parts", [("1D-src", 3), ("2D", 1)])
def test_placed_incidences_change_no_result(chains, strategy, parts, monkeypatch):
    """Laid out by part, on the graph and on its dual; one part that holds everything is split."""
    with monkeypatch.context() as patch:
        if parts == 1:
            patch.setattr(skew, "hot_limit", lambda *_: 3)
        placed = chains.assign_parts(strategy, parts).prepare()
    assert (placed.layout.lanes["he"].hot is not None) == (parts == 1)
    hops = lambda g: [values(x) for done in [shortest_path(g, 7, 51)] for x in (done.hv, done.he)]
    links = lambda g: sorted(tuple(r) for r in g.links().select("he_id", "hv_id", "copies").collect())
    assert runs(placed) == [pytest.approx(x) for x in runs(chains)] and hops(placed.dual()) == hops(chains.dual()) and links(placed) == links(chains)
    placed.release()


def test_a_null_part_is_a_part(chains):
    placed = type(chains)(chains.hv, chains.he, chains.inc.withColumn("part", F.when(F.col("hv_id") % 2 == 0, 1)))
    assert runs(placed) == [pytest.approx(x) for x in runs(chains)]


def test_placed_links_do_not_move(chains):
    """Senders go to the parts; messages are combined there before the one shuffle to the receivers."""
    placed = chains.assign_parts("2D", 4).prepare()
    lane, spark = placed.layout.lanes["he"], chains.inc.sparkSession
    state = layout.NodeState(chains.hv, placed.layout.parts, layout.loop_session(spark, placed.layout.parts))
    senders = state.base.select(F.col("id").alias("src_id"), F.lit(1).alias("msg"))
    text = plan(lane.join(senders).groupBy("dst_id").agg(F.min("msg").alias("msg")))
    assert text.count("Exchange hashpartitioning(part") == 1 and text.count("Exchange hashpartitioning(dst_id") == 1
    assert text.count("Exchange hashpartitioning") == 2 and "partial_min" in text, text
    state.release()
    placed.release()


def test_traffic_follows_the_placement(spark):
    """A star of one hyperedge: one message a part, one copy of every member's row."""
    graph = incidence_graph(spark, [(100, v) for v in range(40)])
    flood = Program(lambda ss, id, attr, msg: Step(sends=[Send(id)]), "min")
    start = graph.map_vertices(lambda id, _: id).map_hyperedges(lambda id, _: id)
    found = {}
    for strategy in ("1D-src", "1D-dst"):
        placed = start.assign_parts(strategy, 5)
        found[strategy] = []
        placed.compute(1, F.lit(0).cast("bigint"), flood, flood, traffic=found[strategy])
        used = placed.inc.select("part").distinct().count()
        assert found[strategy] == [(0, 40, used)]
    assert found["1D-dst"][0][2] == 1 < found["1D-src"][0][2]
    with pytest.raises(ValueError, match="assign_parts"):
        start.compute(1, F.lit(0).cast("bigint"), flood, flood, traffic=[])


def test_buckets_hold_enough_links_for_messages_to_combine(spark, monkeypatch):
    from weft.operators import layout
    from weft.sources import from_incidences

    monkeypatch.setattr("weft.session.LINKS_PER_PARTITION", 10)
    monkeypatch.setattr(layout, "BUCKET_LINKS", 100)
    prepared = from_incidences(spark.range(400).selectExpr("id % 40 AS he_id", "id AS hv_id")).prepare()
    assert prepared.layout.parts == 4
    prepared.release()


def test_large_parts_are_split_by_the_buckets_of_the_loop(spark, monkeypatch):
    from weft.sources import from_incidences

    monkeypatch.setattr("weft.session.LINKS_PER_PARTITION", 10)
    spark.conf.set("spark.weft.hotRows", "50")
    try:
        graph = from_incidences(spark.range(400).selectExpr("id % 40 AS he_id", "id AS hv_id")).assign_parts("1D-src", 2)
        prepared = graph.prepare()
        assert prepared.layout.parts == 40
        for lane in prepared.layout.lanes.values():  # 200 links a part, 10 a bucket; the session has 2 partitions
            assert [row._fan for row in lane.hot.collect()] == [4, 4]
        prepared.release()
    finally:
        spark.conf.unset("spark.weft.hotRows")


def test_few_parts_lie_in_buckets_of_their_own(spark):
    """Hashed, five parts in eight buckets collide; then one task has the links of several."""
    from weft.sources import from_incidences

    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        graph = from_incidences(spark.range(4000).selectExpr("id % 40 AS he_id", "id % 1000 AS hv_id")).assign_parts("1D-dst", 5)
        prepared = graph.prepare()
        want = sorted(r["count"] for r in graph.inc.distinct().groupBy("part").count().collect())
        for lane in prepared.layout.lanes.values():
            loop = layout.loop_session(spark, prepared.layout.parts)
            rows = loop.table(lane.table.bucketed_as[0]).groupBy("part", F.input_file_name().alias("file")).count().collect()
            assert sorted(r["count"] for r in rows) == want and len({r.file for r in rows}) == 5
        assert prepared.links().agg(F.sum("copies")).first()[0] == 4000
        prepared.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_buckets_of_placed_links_grow_with_many_links(spark, monkeypatch):
    from weft.sources import from_incidences

    monkeypatch.setattr("weft.session.LINKS_PER_PARTITION", 10)
    monkeypatch.setattr(layout, "BUCKET_LINKS", 50)
    monkeypatch.setattr(layout, "BUSY", 6)
    for links, parts in ((40, 4), (100, 6), (600, 12)):
        prepared = from_incidences(spark.range(links).selectExpr("id % 4 AS he_id", "id AS hv_id")).assign_parts("1D-src", 3).prepare()
        assert prepared.layout.parts == parts
        prepared.release()
