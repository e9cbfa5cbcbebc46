"""Skew, plans, lineage and storage."""

import os

import pytest
from conftest import incidence_graph, values
from pyspark.sql import functions as F

from weft.operators import superstep
from weft.operators.routes import Routes, arrange
from weft.operators.skew import hot_keys
from weft.plans import connected_components, pagerank, pagerank_on_graph, shortest_path
from weft.plans.pagerank import pagerank_graph
from weft.session import checkpoint_folder, cut, fixed_plans


@pytest.fixture
def hot(spark):
    """Every key with more than a handful of rows counts as hot; several partitions."""
    spark.conf.set("spark.weft.hotRows", "4")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.weft.hotRows")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.fixture(scope="module")
def star(spark):
    """Vertex 0 is in every hyperedge, hyperedge 0 holds every vertex, and copies abound."""
    rows = [(h, 0) for h in range(60)] + [(0, v) for v in range(1, 50)]
    rows += [(h, 1 + h % 49) for h in range(60)] + [(7, 7)] * 40
    return incidence_graph(spark, rows)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_few_and_split(spark, hot):
    rows = spark.range(400).selectExpr("IF(id % 3 = 0, 0, id) AS k")
    found = hot_keys(rows, "k", 400).collect()
    assert [(r.k, r._fan) for r in found] == [(0, 3)]  # limit is 2 * 400 / 16 = 50
    assert hot_keys(spark.range(400), "id", 400) is None


def test_splitting_hot_nodes_changes_no_result(spark, star, monkeypatch):
    def results():
        ranked = pagerank(star, 3)
        return (
            values(ranked.hv),
            values(ranked.he),
            values(connected_components(star).hv),
            values(shortest_path(star, 5, 3).he),
            values(pagerank_on_graph(pagerank_graph(star), 2).v),
        )

    expected = results()
    seen = []
    original = Routes.__init__
    monkeypatch.setattr(
        Routes, "__init__", lambda self, *a: (original(self, *a), seen.append(self.hot is not None))[0]
    )
    monkeypatch.setattr("weft.session.LINKS_PER_PARTITION", 10)
    spark.conf.set("spark.weft.hotRows", "4")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = results()
    finally:
        spark.conf.unset("spark.weft.hotRows")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert any(seen)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b)


def test_hot_links_spread_over_partitions(spark, hot):
    links = spark.range(1000).selectExpr("IF(id % 3 = 0, 0, id) AS src_id", "id AS dst_id", "1L AS copies")
    routes = Routes(links, 1000)
    sizes = routes.table.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 250  # the hot sender alone has 334
    heard = routes.join(spark.range(1000).withColumnRenamed("id", "src_id"))
    assert heard.count() == 1000
    routes.release()


def test_half_step_shuffles_messages_only(spark):
    links = spark.range(5000).selectExpr("id % 100 AS src_id", "id % 77 AS dst_id", "1L AS copies")
    with fixed_plans(spark, 4):
        routes = Routes(links, 5000)
        state = cut(arrange(spark.range(100).withColumn("attr", F.lit(1.0)), 4))
        target = cut(arrange(spark.range(77).withColumn("attr", F.lit(0.0)), 4))
        program = superstep.Program(lambda ss, id, attr, msg: superstep.Step(msg), "sum")
        rows = state.withColumn("_ran", F.lit(True)).withColumn("_sent0", F.lit(True))
        sender = superstep._State(
            rows.withColumn("_out0", F.col("attr")), [superstep.Send(F.lit(0.0))]
        )
        messages = superstep._deliver(sender, routes, "sum").hint("merge")
        heard = target.join(messages, F.col("id") == F.col("dst_id"), "left")
        text = plan(superstep._run(heard, F.col("dst_id").isNotNull(), program, 1).rows)
        above_cache = [line for line in text.split("\n") if "Exchange" in line and "REPARTITION" not in line]
        routes.release()
    assert len(above_cache) == 1 and "dst_id" in above_cache[0]
    assert "BroadcastExchange" not in text


def test_adaptive_execution_splits_a_skewed_join(spark, star):
    """Copies of one incidence land in one shuffle partition, which the join then splits."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        inc = spark.range(0, 40000, 1, 8).selectExpr(
            "CAST(IF(id % 3 = 0, 5, id % 60) AS bigint) AS he_id", "CAST(IF(id % 3 = 0, 5, id % 50) AS bigint) AS hv_id"
        )
        he = inc.groupBy(F.col("he_id").alias("id")).agg(F.count("*").alias("attr"))
        hv = inc.select(F.col("hv_id").alias("id")).distinct().withColumn("attr", F.lit(1))
        graph = type(star)(hv, he, inc)
        rows = graph.triplets()
        assert rows.count() == 40000
        frame = graph.triplets()
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        assert "skew=true" in plan(frame)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lineage_is_cut_and_old_states_are_deleted(spark, star):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    done = connected_components(star, max_iters=None)
    kept = set(os.listdir(folder)) - before
    assert len(kept) == 2  # the last state of each role
    assert len(plan(done.hv)) < 20_000
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scans_read_only_what_is_needed(spark):
    from conftest import SF_DIR

    from checks.queries import orders_parts

    graph = orders_parts(spark, SF_DIR)
    text = plan(graph.degrees().hv)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text or "ReadSchema: struct<l_partkey:bigint>" in text
    kept = plan(graph.sub_hypergraph(lambda id, _: id < 10).hv)
    assert "LessThan(p_partkey,10)" in kept


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """Tasks follow the pairs that come out of the pairing, not the members that go in."""
    from conftest import incidence_graph

    from weft.operators import projection

    rows = [(h, v) for h in range(20) for v in range(h, h + 20)]
    graph = incidence_graph(spark, rows)
    one = graph.he.select(F.col("id").alias("he_id"), F.lit(1).alias("msg"))
    want = sorted(map(tuple, projection.member_pairs(graph, one).collect()))
    assert projection.listed_pairs(graph) == (20, 20 * 210) and len(want) == 20 * 210
    monkeypatch.setattr(projection, "PAIRS_PER_TASK", 100)
    for block in (50, 5):
        pairs = projection.member_pairs(graph, one, block)
        sizes = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert pairs.rdd.getNumPartitions() == 42 and max(sizes) < 1000
        assert sorted(map(tuple, pairs.collect())) == want
