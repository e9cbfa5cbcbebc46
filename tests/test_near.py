"""Wide messages travel once to each part of their receivers, not once per link."""

import pytest
from conftest import incidence_graph
from pyspark.sql import functions as F

from weft import Program, Send, Step
from weft.operators import near
from weft.operators.layout import slot_keys
from weft.operators.near import SLOT, NearLane, parts_for, rows_shipped
from weft.plans import neighbour_counts, neighbours


@pytest.fixture(scope="module")
def lots(spark):
    """30 hyperedges of 100 vertices, each vertex in about 4 of 30, and some in copies."""
    rows = [(h, 100 + (h * 37 + k * (1 + h % 7)) % 750) for h in range(30) for k in range(100)]
    return incidence_graph(spark, rows + rows[:50])


def close(want):
    """Beyond some 380 members an estimate depends a little on the order of the union."""
    return pytest.approx(want, rel=0.03)


def united(graph):
    """What every vertex estimates if each incidence brings it a sketch."""
    inc = graph.inc.select("he_id", "hv_id")
    sketches = inc.groupBy("he_id").agg(F.hll_sketch_agg("hv_id", F.lit(12)).alias("s"))
    rows = inc.join(sketches, "he_id").groupBy("hv_id").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n"))
    return {r.hv_id: r.n for r in rows.collect()}


@pytest.fixture
def joined(monkeypatch):
    """Rows of senders that each near lane ships."""
    seen, plain = [], NearLane.join

    def join(self, senders, *rest):
        seen.append(self.copies.count())
        return plain(self, senders, *rest)

    monkeypatch.setattr(NearLane, "join", join)
    return seen


def test_slots_are_dealt_to_parts_of_their_own(spark):
    keys = slot_keys(spark, 13)
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(13, "k")
    assert sorted(r[0] for r in rows.select(F.spark_partition_id()).collect()) == list(range(13))


def test_parts_follow_what_a_part_holds(spark, monkeypatch):
    few = spark.sparkContext.defaultParallelism
    assert parts_for(spark, 1000, 10, 1000) == few
    assert parts_for(spark, 40_000_000, 10, 1000) == 10
    monkeypatch.setattr(near, "PART_BYTES", 1000)
    parts = parts_for(spark, 400, 100, 10_000)
    assert rows_shipped(parts, 400, 100) / parts <= 10.01  # a tenth of the senders a part


def test_sketches_travel_once_to_each_part(spark, lots, joined):
    want = united(lots)
    got = {r.id: r.estimate for r in neighbour_counts(lots).collect()}
    assert got == close({r.id: want.get(r.id, 0) for r in lots.hv.collect()})
    assert joined and joined[0] <= 30 * spark.sparkContext.defaultParallelism < lots.inc.count()


def test_waves_and_busy_vertices_change_no_estimate(spark, lots, joined, monkeypatch):
    want = {r.id: r.estimate for r in neighbour_counts(lots).collect()}
    monkeypatch.setattr(near, "WAVE_BYTES", 1)
    monkeypatch.setattr(neighbours, "parts_for", lambda *_: 9)
    spark.conf.set("spark.weft.hotRows", "5")
    spark.conf.set("spark.sql.shuffle.partitions", "1500")
    try:
        assert {r.id: r.estimate for r in neighbour_counts(lots).collect()} == close(want)
    finally:
        spark.conf.unset("spark.weft.hotRows")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(joined) == 4  # one before; nine slots, four at a time


def test_no_vertices_and_null_ids(spark, lots):
    none = type(lots)(lots.hv.limit(0), lots.he.limit(0), lots.inc.limit(0))
    assert neighbour_counts(none).count() == 0
    odd = lots.inc.union(spark.sql("SELECT CAST(NULL AS bigint), 100L UNION ALL SELECT 1L, CAST(NULL AS bigint)"))
    with_odd, plain = ({r.id: r.estimate for r in neighbour_counts(g).collect()} for g in (type(lots)(lots.hv, lots.he, odd), lots))
    assert with_odd == close(plain)


def test_joined_rows_are_neither_shuffled_nor_sorted(spark, lots):
    from weft.operators.layout import loop_session

    links = lots.links().select(F.col("he_id").alias("src_id"), F.col("hv_id").alias("dst_id"))
    lane = NearLane(links, 5, 3)
    loop = loop_session(spark, 5)
    for key, value in near.SETTINGS.items():
        loop.conf.set(key, value)
    senders = loop.createDataFrame([(h, "x") for h in range(2000)], "src_id bigint, msg string")
    tables = loop.table(lane.table.bucketed_as[0]), loop.table(lane.copies.bucketed_as[0])
    rows = lane.join(senders, None, tables).groupBy(SLOT, "dst_id").agg(F.count("msg").alias("n"))
    text = rows._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("ShuffledHashJoin")]
    assert "Exchange" not in above and "Sort " not in above
    assert rows.agg(F.sum("n")).first()[0] == links.count()
    lane.release()


@pytest.mark.parametrize("whole", [True, False])
def test_sketch_messages_of_a_program(spark, lots, joined, monkeypatch, whole):
    """Hyperedges send their sketch to all members; attributes are the union of those heard."""
    if not whole:
        monkeypatch.setattr("weft.operators.layout.WHOLE_ROWS", -1)
    own = lots.hv.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(12)).alias("attr"))
    start = lots.with_tables(own, lots.he.withColumn("attr", F.lit(None).cast("binary")))

    def vertex(superstep, id, attr, msg):
        return Step(sends=[Send(attr)]) if superstep == 0 else Step(msg, [Send(msg)])

    def hyperedge(superstep, id, attr, msg):
        return Step(msg, [Send(msg)])

    def run(rounds):
        done = start.compute(rounds, F.lit(None).cast("binary"), Program(vertex), Program(hyperedge))
        return {r.id: r.n for r in done.hv.select("id", F.hll_sketch_estimate("attr").alias("n")).collect()}

    found = {rounds: run(rounds) for rounds in (2, 3)}
    assert len(joined) == 3  # from hyperedges, once and twice; vertices are more
    monkeypatch.setattr("weft.operators.superstep._near", lambda *_: None)
    assert all(run(rounds) == close(found[rounds]) for rounds in found)
    want = united(lots)
    assert found[2] == close({r.id: want.get(r.id, 1) for r in lots.hv.collect()})
