"""What a finished step leaves on disk: its tables, not the shuffles that made them."""

import re

from conftest import incidence_graph, values
from pyspark.sql import functions as F

from weft.operators.layout import bucketed, drop_bucketed
from weft.operators.routes import Routes
from weft.plans import pagerank_graph, pagerank_on_graph
from weft.session import CLEANUP_CONF, forget, kept


def shuffled(spark):
    """Bytes of shuffle data on disk, by shuffle."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" "))
    files = {n: disk.getFile(n).length() for n in names}
    found = {}
    for name, size in files.items():
        number = int(name.split("_")[1])
        found[number] = found.get(number, 0) + size
    return found


def added(spark, before):
    return sum(size for number, size in shuffled(spark).items() if number not in before)


def test_tables_leave_no_shuffle(spark):
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("id"))
    before, setting = shuffled(spark), spark.conf.get(CLEANUP_CONF, None)
    table = kept(rows.repartition(3, "id").distinct(), "rows")
    other = bucketed(rows.repartition(3, "id"), ["id"], 3, "rows")
    assert added(spark, before) == 0
    assert table.count() == other.count() == 50_000
    assert spark.conf.get(CLEANUP_CONF, None) == setting
    forget(table)
    drop_bucketed(other)


def test_one_mode_pagerank_leaves_what_lists_its_edges(spark, monkeypatch):
    """When the loop begins, edges are a table: neither their shuffles nor a second copy remain."""
    graph = incidence_graph(spark, [(h, v) for h in range(4) for v in range(h * 10, 200)])
    graph = graph.with_tables(graph.hv, graph.he.withColumn("attr", F.struct(F.lit(200).alias("card"), F.lit(1).alias("weight"))))
    seen, plain, before = [], Routes.__init__, shuffled(spark)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()

    def init(self, *given):
        plain(self, *given)
        seen.append((added(spark, before), spark.sparkContext._jsc.getPersistentRDDs().size() - cached))

    monkeypatch.setattr(Routes, "__init__", init)
    ranks = values(pagerank_on_graph(pagerank_graph(graph), 2).v)
    assert len(ranks) == 200 and abs(sum(ranks.values()) - 200) < 1e-6
    [(left, copies)] = seen  # 40,000 edges take some 500 KB a shuffle
    assert left < 60_000 and copies <= 1  # the vertices
