"""Sources, dense ids, merged groups and the batch job."""

import random

import pytest
from conftest import CYCLE, PAPERS, TREE, sets_by_id
from pyspark.sql import functions as F

from weft.jobs import shortest_path as job
from weft.operators.ids import dense_ids
from weft.sources import from_groups, from_incidences, parse_records, read_csv, read_records
from weft.sources.incidence import cardinality_bounds
from weft.sources.records import count_forms, records_hypergraph


def write_csv(path, rows):
    path.write_text("".join(f"{h},{v}\n" for h, v in rows))
    return str(path)


def test_csv(spark, tmp_path):
    graph = read_csv(spark, write_csv(tmp_path / "tree.csv", TREE))
    assert {r.id: tuple(r.attr) for r in graph.he.collect()} == {10: (3, 1), 11: (3, 1), 12: (4, 1), 13: (2, 1)}
    assert {r.id for r in graph.hv.collect()} == set(range(1, 10))
    assert graph.inc.count() == 12


def test_csv_counts_repeated_lines(spark, tmp_path):
    graph = read_csv(spark, write_csv(tmp_path / "twice.csv", [(0, 1), (0, 1)]))
    assert graph.he.first().attr.card == 2 and graph.inc.count() == 2


@pytest.mark.parametrize("line", ["1", "1,2,3", "a,2", "1,x", "1,", ",2"])
def test_malformed_csv_lines_fail(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text(f"0,1\n{line}\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "bad.csv")).inc.collect()


@pytest.mark.parametrize("argument, kept", [(3, {10, 11, 13}), (1, set()), (0, {10, 11, 12, 13}), (-3, {10, 11, 12})])
def test_cardinality_bounds(spark, argument, kept):
    inc = spark.createDataFrame(TREE, "he_id bigint, hv_id bigint")
    graph = from_incidences(inc, **cardinality_bounds(argument))
    assert {r.id for r in graph.he.collect()} == kept
    assert {r.id for r in graph.hv.collect()} == {r.hv_id for r in graph.inc.collect()}


LINES = PAPERS + [
    "not json",
    '["no year", "x", ["v1"]]',
    '["spaced year", " 2015", ["v1"]]',
    '["old", "1990", ["v1"]]',
    '{"title": "object"}',
    '["short", "2015"]',
    '["long", "2015", ["v1"], 1]',
    '["number year", 2015, ["v1"]]',
    '["no list", "2015", "v1"]',
    '["dup", "2015", ["v3", "v2", "v3", 7, null]]',
    '["nobody", "2015", []]',
    '["e1-1", "+2016", ["v3", "v1", "v2"]]',
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(line,) for line in LINES], "value string").coalesce(1)


def test_records(lines):
    rows = [(r.title, r.year, r.authors) for r in parse_records(lines, since=2000).collect()]
    assert rows[6:] == [("dup", 2015, ["v3", "v2"]), ("nobody", 2015, []), ("e1-1", 2016, ["v3", "v1", "v2"])]
    assert len(rows) == 9
    assert parse_records(lines).count() == 10
    forms = {r.form: r["lines"] for r in count_forms(lines).collect()}
    assert forms == {"unparsable": 1, "misshapen": 5, "record": len(LINES) - 6}
    with pytest.raises(Exception, match="not a record"):
        parse_records(lines, strict=True).collect()


def test_records_from_a_file_merge_into_sets(spark, tmp_path):
    (tmp_path / "records.json").write_text("\n".join(LINES))
    graph = records_hypergraph(read_records(spark, str(tmp_path / "records.json"), since=2000))
    sets = sets_by_id(graph)
    merged = {sets[r.id]: tuple(r.attr) for r in graph.he.collect()}
    assert merged == {("v1", "v2", "v3"): (3, 2), ("v2", "v3"): (2, 3), ("v1", "v2"): (2, 3)}
    assert {r.id: r.attr for r in graph.hv.collect()} == {0: "v1", 1: "v2", 2: "v3"}
    assert min(sets) == 3  # hyperedge ids follow the vertex ids


def weak(member, salt):
    """Hashes so poor that different sets share fingerprints at first."""
    if salt == 0:
        return [F.lit(0).cast("bigint")]
    return [F.xxhash64(member, F.lit(salt))]


@pytest.mark.parametrize("hashes", [None, weak])
def test_merging_is_exact_even_with_colliding_hashes(spark, hashes):
    generator = random.Random(3)
    records = [(r, generator.sample("abcdef", generator.randint(1, 3))) for r in range(60)]
    rows = spark.createDataFrame([(r, m) for r, ms in records for m in ms], "r bigint, m string")
    extra = {} if hashes is None else {"hashes": hashes}
    graph = from_groups(rows.union(rows.limit(5)), "r", "m", **extra)
    weights = {}
    for _, ms in records:
        weights[tuple(sorted(ms))] = weights.get(tuple(sorted(ms)), 0) + 1
    sets = sets_by_id(graph)
    assert {sets[r.id]: r.attr.weight for r in graph.he.collect()} == weights
    assert all(len(sets[r.id]) == r.attr.card for r in graph.he.collect())
    # Hyperedges are numbered by their first record.
    first = {}
    for r, ms in records:
        first.setdefault(tuple(sorted(ms)), r)
    order = sorted(first, key=first.get)
    assert [sets[i] for i in sorted(sets)] == order


def test_dense_ids_follow_the_order(spark):
    keys = spark.range(1000).selectExpr("(id * 7919) % 1000 AS a").repartition(7)
    rows = dense_ids(keys, ["a"]).collect()
    assert {r.a: r.id for r in rows} == {i: i for i in range(1000)}
    assert dense_ids(keys.where("a < 0"), ["a"]).count() == 0


def test_batch_job(spark, tmp_path):
    path = write_csv(tmp_path / "cycle.csv", CYCLE)
    rows = job.run(spark, path, 0, "HybridDst", 2, 3, 4, 2, 1).collect()
    assert [r.run for r in rows] == [0, 1, 2] and all(r.ms >= 0 for r in rows)
    assert rows[0].messages is None and rows[1].messages == rows[2].messages > 0 and rows[1].copies > 0
    with pytest.raises(ValueError, match="unknown partition strategy"):
        job.run(spark, path, 0, "Nowhere", 2, 3, 4, 1, 1)




def test_pairs_stay_with_their_record(spark):
    from weft.operators.layout import drop_bucketed
    from weft.sources.groups import _by_record, merge_identical

    pairs = spark.range(1000).selectExpr("id div 4 AS record", "id div 4 AS label", "id % 8 AS member")
    placed = _by_record(pairs)
    plan = placed.groupBy("record").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and placed.count() == 1000
    members, sets = merge_identical(placed)
    assert {tuple(r) for r in sets.collect()} == {(0, 4, 125, 0), (1, 4, 125, 1)}  # a set goes by its smallest record
    assert sorted(tuple(r) for r in members.collect()) == [(i, 4 * i + j) for i in (0, 1) for j in range(4)]
    drop_bucketed(placed)
    spark.conf.set("spark.weft.hotRows", "10")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        few = spark.range(1000).selectExpr("IF(id < 990, 1, id) AS record", "id AS member")
        assert _by_record(few) is few  # one record has most: a bucket would hold them all
    finally:
        spark.conf.unset("spark.weft.hotRows")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
