"""The superstep loop: delivery, recipients, combiners, activity."""

import pyarrow as pa
import pytest
from conftest import incidence_graph
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import AllExcept, ArrowProgram, HyperGraph, Only, Program, Send, Step
from weft.operators.combiners import ByField, Concatenate, SumByKey, default_combiner, fold_by_key, resolve
from weft.plans import connected_components, random_walk, shortest_path


def zero():
    return F.lit(0).cast("bigint")


def heard(graph, sends, combiner="sum", kind="bigint"):
    """What hyperedges hear if every vertex sends once, by hyperedge id."""
    start = graph.map_hyperedges(lambda *_: F.lit(None).cast(kind))
    done = start.compute(
        1,
        zero(),
        Program(lambda ss, id, attr, msg: Step(sends=sends(id)), combiner),
        Program(lambda ss, id, attr, msg: Step(msg), combiner),
    )
    return {row.id: row.attr for row in done.he.collect()}


def members(graph):
    found = {}
    for row in graph.inc.collect():
        found.setdefault(row.he_id, []).append(row.hv_id)
    return found


def test_recipients(tree):
    inside = members(tree)
    assert heard(tree, lambda id: [Send(id)]) == {h: sum(m) for h, m in inside.items()}
    only = heard(tree, lambda id: [Send(id, Only([10, 12]))])
    assert only == {10: 6, 11: None, 12: 26, 13: None}
    rest = heard(tree, lambda id: [Send(id, AllExcept([10, 12]))])
    assert rest == {10: None, 11: 12, 12: None, 13: 17}
    own = heard(tree, lambda id: [Send(id, Only(F.array(id + 8, id + 9)))])
    assert own == {10: 1 + 2, 11: 3, 12: None, 13: None}


def test_message_by_destination_and_several_sends(tree):
    inside = members(tree)
    by_dst = heard(tree, lambda id: [Send(lambda dst: dst * id)])
    assert by_dst == {h: h * sum(m) for h, m in inside.items()}
    several = heard(
        tree, lambda id: [Send(id), Send(lambda dst: dst), Send(F.lit(1000).cast("bigint"), when=id > 7)]
    )
    assert several == {h: sum(m) + h * len(m) + 1000 * sum(v > 7 for v in m) for h, m in inside.items()}


@pytest.mark.parametrize("name, expected", [("max", max), ("min", min)])
def test_named_combiners(tree, name, expected):
    assert heard(tree, lambda id: [Send(id)], name) == {h: expected(m) for h, m in members(tree).items()}


def test_copies_of_an_incidence_deliver_several_messages(spark):
    graph = HyperGraph.from_tables(
        spark.createDataFrame([(0, 1)] * 5 + [(0, 2)], "he_id bigint, hv_id bigint"),
        spark.createDataFrame([(1,), (2,)], "id bigint"),
        spark.createDataFrame([(0,)], "id bigint"),
    )
    assert heard(graph, lambda id: [Send(id)]) == {3: 7}
    assert heard(graph, lambda id: [Send(id)], lambda a, b: a + b) == {3: 7}
    assert heard(graph, lambda id: [Send(id)], "mode") == {3: 1}
    lists = heard(graph, lambda id: [Send(F.array(id))], Concatenate(), "array<bigint>")
    assert lists == {3: [1, 1, 1, 1, 1, 2]}
    with pytest.raises(ValueError, match="6 entries, limit 5"):
        heard(graph, lambda id: [Send(F.array(id))], Concatenate(5), "array<bigint>")


def test_implied_combiners(tree):
    histogram = heard(
        tree, lambda id: [Send(F.create_map(id % 2, F.lit(1).cast("bigint")))], None, "map<bigint,bigint>"
    )
    expected = {
        h: {k: sum(v % 2 == k for v in m) for k in {v % 2 for v in m}} for h, m in members(tree).items()
    }
    assert histogram == expected
    pair = heard(
        tree,
        lambda id: [Send(F.struct(id.alias("a"), F.lit(1).cast("bigint").alias("b")))],
        None,
        "struct<a:bigint,b:bigint>",
    )
    assert {h: tuple(p) for h, p in pair.items()} == {h: (sum(m), len(m)) for h, m in members(tree).items()}
    with pytest.raises(TypeError):
        default_combiner(T.StringType())


def test_zero_iterations_run_vertices_once(tree):
    double = Program(lambda ss, id, attr, msg: Step(id * 2, [Send(id)]), "sum")
    keep = Program(lambda ss, id, attr, msg: Step(msg, [Send(msg)]), "sum")
    start = tree.map_vertices(lambda *_: zero()).map_hyperedges(lambda *_: zero())
    done = start.compute(0, zero(), double, keep)
    assert {r.id: r.attr for r in done.hv.collect()} == {v: 2 * v for v in range(1, 10)}
    assert {r.attr for r in done.he.collect()} == {0}


def test_activity_counts(tree, cycle, monkeypatch):
    """Nodes reached per half step; the run stops when nobody sends."""
    def trace(run, graph, *args):
        counts = []
        original = HyperGraph.compute
        monkeypatch.setattr(
            HyperGraph,
            "compute",
            lambda self, *a: original(self, *a, trace=counts),
        )
        run(graph, *args)
        monkeypatch.setattr(HyperGraph, "compute", original)
        while counts and counts[-1] == 0:
            counts.pop()
        return counts

    assert trace(shortest_path, tree, 10, 1, "sum") == [1, 3, 2, 3, 2, 4, 2, 2, 1]
    assert trace(shortest_path, cycle, 10, 1, "sum") == [2, 5, 4, 5, 4, 5, 2]
    assert trace(connected_components, tree, 10) == [4, 9, 4, 8, 3, 5, 2, 3, 1]
    assert len(trace(random_walk, tree, 3, [1], 0.15, 1e-4)) == 5


def test_fold_in_slices_equals_one_fold(spark):
    rows = spark.range(500).selectExpr(
        "id % 3 AS dst_id", "id % 100 AS msg", "CAST(1 + id % 4 AS bigint) AS copies"
    )
    expected = {r[0]: r[1] for r in rows.groupBy("dst_id").agg(F.sum(F.col("msg") * F.col("copies"))).collect()}
    for group_rows in (8, 10_000):
        folded = fold_by_key(rows, ["dst_id"], "msg", lambda a, b: a + b, group_rows)
        assert {r.dst_id: r.msg for r in folded.collect()} == expected


def test_attributes_are_never_narrowed(tree):
    start = tree.map_vertices(lambda *_: F.lit(3)).map_hyperedges(lambda *_: F.lit(None).cast("bigint"))

    def run(become):
        return start.compute(1, zero(), Program(lambda ss, id, attr, msg: Step(become(attr), [Send(id)]), "max"), Program(lambda ss, id, attr, msg: Step(msg), "max"))

    with pytest.raises(TypeError, match="int into double"):
        run(lambda attr: attr * F.lit(0.75))
    with pytest.raises(TypeError, match="int into bigint"):
        run(lambda attr: attr.cast("bigint"))
    assert {r.attr for r in run(lambda attr: F.lit(7).cast("tinyint")).hv.collect()} == {7}
    wide = start.map_vertices(lambda *_: F.struct(F.lit(1.5).alias("x")))
    done = wide.compute(0, zero(), Program(lambda ss, id, attr, msg: Step(F.struct(F.lit(2).alias("x")))), Program(lambda *_: Step()))
    assert {r.attr.x for r in done.hv.collect()} == {2.0}


def test_empty_maps_arrive(tree):
    empty = F.create_map().cast("map<string,bigint>")
    got = heard(tree, lambda id: [Send(F.when(id == 1, F.create_map(F.lit("a"), id)).otherwise(empty))], None, "map<string,bigint>")
    assert got == {10: {"a": 1}, 11: {}, 12: {}, 13: {}}


def merged(spark, rows, kind, combiner=None):
    frame = spark.createDataFrame(rows, f"dst_id bigint, msg {kind}, copies bigint")
    combiner = combiner or default_combiner(frame.schema["msg"].dataType)
    return {r.dst_id: r.msg for r in combiner.merge(frame).collect()}


def test_implied_combiners_of_nested_types(spark):
    rows = [(1, {"a": {"x": (1, [3])}}, 2), (1, {"a": {"x": (5, [1]), "y": (2, [])}, "b": {}}, 1), (2, {}, 1)]
    got = merged(spark, rows, "map<string,map<string,struct<n:bigint,list:array<int>>>>")
    plain = {d: {k: {i: tuple(leaf) for i, leaf in inner.items()} for k, inner in m.items()} for d, m in got.items()}
    assert plain == {1: {"a": {"x": (7, [1, 3, 3]), "y": (2, [])}, "b": {}}, 2: {}}
    got = merged(spark, [(1, ([1, 2], 1.5), 1), (1, ([0], 2.0), 2)], "struct<ids:array<int>,total:double>")
    assert tuple(got[1]) == ([0, 0, 1, 2], 5.5)
    assert isinstance(default_combiner(T.StructType([T.StructField("a", T.ArrayType(T.IntegerType()))])), ByField)
    with pytest.raises(TypeError, match="string"):
        default_combiner(T.StringType())


def test_sketches_unite(spark):
    ids = spark.range(2000).select(F.col("id"), (F.col("id") % 5).alias("part"))
    rows = ids.groupBy("part").agg(F.hll_sketch_agg("id").alias("msg")).select(F.lit(1).alias("dst_id"), "msg", F.lit(3).alias("copies"))
    for combiner in (resolve("sketch"), default_combiner(T.BinaryType())):
        (row,) = combiner.merge(rows).select(F.hll_sketch_estimate("msg").alias("n")).collect()
        assert abs(row.n - 2000) < 100


def test_entry_bounds_are_the_callers(spark):
    rows = [(1, {str(i): 1}, 1) for i in range(20)]
    assert len(merged(spark, rows, "map<string,bigint>")[1]) == 20
    with pytest.raises(ValueError, match="20 entries, limit 19"):
        merged(spark, rows, "map<string,bigint>", SumByKey(19))


@pytest.mark.parametrize("group_rows", [1, 2, 3])
def test_folding_in_the_smallest_groups_ends(spark, group_rows):
    rows = spark.createDataFrame([(1, i, 1) for i in range(50)] + [(2, 7, 3)], "k int, v bigint, copies bigint")
    done = fold_by_key(rows, ["k"], "v", lambda a, b: a + b, group_rows)
    assert {r.k: r.v for r in done.collect()} == {1: 1225, 2: 21}


def test_loops_of_several_threads_leave_the_session_alone(spark, tree, cycle):
    from concurrent.futures import ThreadPoolExecutor

    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]

    def labels(graph):
        done = connected_components(graph)
        return sorted((r.id, r.attr._2) for t in (done.hv, done.he) for r in t.collect())

    alone = [labels(g) for g in (tree, cycle, tree)]
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(labels, (tree, cycle, tree))) == alone
    assert [spark.conf.get(k) for k in keys] == before


def test_partitions_follow_the_data(spark):
    from weft.session import partitions_for

    assert partitions_for(spark, 10) == 1 and partitions_for(spark, 1_000_000) == 10
    assert partitions_for(spark, 10**10) == 10_000 and partitions_for(spark, 10**12) == 200_000


SENDS = pa.list_(pa.struct([("to", pa.int64()), ("msg", pa.int64())]))


def relay():
    """A function that travels with its code: workers cannot import the tests."""

    def step(superstep, batch):
        """Nodes divisible by three send nothing, by two to two nodes they name (one of them no neighbour), others to all."""
        ids, msgs = batch.column("id").to_pylist(), batch.column("msg").to_pylist()
        sends = [[] if i % 3 == 0 else [{"to": i % 4 + 12, "msg": i}, {"to": 13, "msg": -i}, {"to": 555, "msg": 9}] if i % 2 == 0 else [{"to": None, "msg": 10 * i}] for i in ids]
        turned = list(reversed(range(len(ids))))  # rows may come back in any order
        return pa.table({"id": [ids[i] for i in turned], "attr": pa.array([msgs[i] for i in turned], pa.int64()), "sends": pa.array([sends[i] for i in turned], SENDS)})

    return step


@pytest.mark.parametrize("placed", [False, True])
@pytest.mark.parametrize("whole", [250_000, -1])
def test_an_arrow_program_sends_none_one_or_many(spark, monkeypatch, whole, placed):
    from weft.operators import layout

    monkeypatch.setattr(layout, "WHOLE_ROWS", whole)
    rows = [(100 + h, v) for h in range(4) for v in range(1, 12) if (v + h) % 3 != 1] + [(100, 2)]
    graph = incidence_graph(spark, rows).map_vertices(lambda id, _: id).map_hyperedges(lambda id, _: id)
    graph = graph.assign_parts("2D", 3) if placed else graph
    keep = Program(lambda ss, id, attr, msg: Step(msg), "sum")
    done = graph.compute(1, F.lit(7).cast("bigint"), ArrowProgram(relay(), "bigint", "sum"), keep)
    want = {12 + h: [] for h in range(4)}  # hyperedge ids follow the vertex ids
    for h, v in [(h - 88, v) for h, v in rows]:
        sends = [] if v % 3 == 0 else [(v % 4 + 12, v), (13, -v)] if v % 2 == 0 else [(h, 10 * v)]
        want[h] += [msg for to, msg in sends if to == h]
    assert {r.id: r.attr for r in done.hv.collect()} == {v: 7 for v in {v for _, v in rows}}
    assert {r.id: r.attr for r in done.he.collect()} == {h: sum(m) if m else h for h, m in want.items()}


def test_an_arrow_program_as_receiver(spark):
    """It runs on the nodes that heard something; the others keep their attribute."""
    graph = incidence_graph(spark, [(100, 4), (101, 1), (101, 3), (102, 5), (102, 6)]).map_vertices(lambda id, _: id).map_hyperedges(lambda id, _: id)
    tell = Program(lambda ss, id, attr, msg: Step(attr + msg, [Send(id, when=id > 3)] if ss == 0 else []), "sum")
    done = graph.compute(None, F.lit(0).cast("bigint"), tell, ArrowProgram(relay(), "bigint", "sum"))
    assert {r.id: r.attr for r in done.he.collect()} == {7: 4, 8: 8, 9: 11}
    assert {r.id: r.attr for r in done.hv.collect()} == {1: 1, 3: 3, 4: 4 + 70, 5: 5, 6: 6}


def test_an_arrow_program_returns_its_nodes(spark):
    graph = incidence_graph(spark, [(100, 1), (100, 2)]).map_vertices(lambda id, _: id).map_hyperedges(lambda id, _: id)
    step = relay()
    lost = ArrowProgram(lambda ss, batch: step(ss, batch).slice(1), "bigint", "sum")
    with pytest.raises(Exception, match="one row for each node"):
        graph.compute(1, F.lit(7).cast("bigint"), lost, Program(lambda ss, id, attr, msg: Step(msg), "sum"))
