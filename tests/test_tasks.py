"""Tasks follow the rows that they make, not a number of partitions that the session sets."""

import pytest
from conftest import incidence_graph
from pyspark.sql import functions as F

from weft.operators import combiners, projection
from weft.operators.combiners import fold_by_key
from weft.plans import neighbour_registers, neighbours


@pytest.fixture(scope="module")
def lots(spark):
    rows = [(1000 + v % 5, v) for v in range(60)] + [(1000 + v % 3, v) for v in range(40)]
    return incidence_graph(spark, rows + [(2000, v) for v in range(50)])


def test_registers_in_small_tasks(lots, monkeypatch):
    want = {tuple(r) for r in neighbour_registers(lots).collect()}
    for module in (neighbours, projection):
        monkeypatch.setattr(module, "PAIRS_PER_TASK", 100, raising=False)
    found = neighbour_registers(lots)
    # 50 * 50 rows of the largest hyperedge, and 12 to 29 members in five others
    assert found.rdd.getNumPartitions() >= 25
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_fold_counts_its_keys_in_small_tasks(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"), F.lit(1).cast("bigint").alias("copies"))
    calls, plain = [], type(rows).repartition
    monkeypatch.setattr(combiners, "TASK_ROWS", 50)
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *by: (calls.append(n), plain(self, n, *by))[1])
    folded = fold_by_key(rows, ["k"], "v", lambda a, b: F.greatest(a, b))
    assert calls == [20, 20]  # keys to be counted, keys to be gathered
    assert {r.k: r.v for r in folded.collect()} == {k: k + 300 * ((999 - k) // 300) for k in range(300)}
