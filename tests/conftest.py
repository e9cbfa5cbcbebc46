import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weft.session import cut  # noqa: E402

SF_DIR = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Two small incidence lists (hyperedge, vertex), and record lines.
TREE = [
    (0, 1), (0, 2), (0, 3), (1, 3), (1, 4), (1, 5),
    (2, 5), (2, 6), (2, 7), (2, 8), (3, 8), (3, 9),
]
CYCLE = TREE + [(4, 9), (4, 10), (5, 10), (5, 11), (5, 1), (5, 2)]
PAPERS = [
    '["e1-1", "2015", ["v1", "v2", "v3"]]',
    '["e2-1", "2015", ["v2", "v3"]]',
    '["e2-2", "2015", ["v2", "v3"]]',
    '["e3-1", "2015", ["v1", "v2"]]',
    '["e3-2", "2015", ["v1", "v2"]]',
    '["e3-3", "2015", ["v1", "v2"]]',
]


def incidence_graph(spark, rows):
    from weft.sources import from_incidences

    graph = from_incidences(spark.createDataFrame(rows, "he_id bigint, hv_id bigint").coalesce(1))
    return written(graph)


def written(graph):
    return type(graph)(cut(graph.hv), cut(graph.he), cut(graph.inc), graph.distinct)


@pytest.fixture(scope="session")
def tree(spark):
    return incidence_graph(spark, TREE)


@pytest.fixture(scope="session")
def cycle(spark):
    return incidence_graph(spark, CYCLE)


@pytest.fixture(scope="session")
def papers(spark):
    from weft.sources import parse_records, records_hypergraph

    lines = spark.createDataFrame([(line,) for line in PAPERS], "value string")
    return written(records_hypergraph(parse_records(lines)))


def values(table, field="_2"):
    """``{id: attr[field]}`` of a node table."""
    return {row.id: row.attr[field] for row in table.collect()}


def sets_by_id(graph):
    """``{hyperedge id: tuple of member names}`` of the papers graph."""
    name = {row.id: row.attr for row in graph.hv.collect()}
    found = {}
    for row in graph.inc.collect():
        found.setdefault(row.he_id, []).append(name[row.hv_id])
    return {key: tuple(sorted(members)) for key, members in found.items()}
