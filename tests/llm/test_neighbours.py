import math

import numpy as np
import pytest
from weft.llm import neighbours
from weft.llm.common import table


def brute(ids, vectors, queries, k=20):
    out = {}
    for q, v in queries:
        near = sorted((-float(np.dot(np.array(x, float), np.array(v, float))), i) for i, x in zip(ids, vectors) if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    monkeypatch.setattr(neighbours, "LEAST", 1)
    base = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = base.select("vec_id", "embedding").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows], [(r.vec_id, r.embedding) for r in rows if r.vec_id % 20 == 0])
    have = found(neighbours.search(base, base.where("vec_id % 20 = 0")))
    assert have.keys() == want.keys()
    hits = [len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {r.vec_id: np.array(r.embedding, float) for r in rows}
    assert all(abs(s - exact[q] @ exact[i]) < 1e-12 for q in have for i, s in have[q])


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(1)
    order = np.array([rng.permutation(10)[:4] for _ in range(50)], np.int32)
    files = neighbours.InvertedFiles(order, 10)
    position = lambda o, p: list(o).index(p) if p in o else 4
    for q in order[:10]:
        distance = [sum(abs(position(q, p) - position(x, p)) for p in range(10)) for x in order]
        assert (4 * 5 - files.similarity(q)).tolist() == distance


def test_small_and_odd_tables(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 3.0]), (2, [3.0, 3.0]), (3, [-1.0, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (40, None), (10, [])]
    schema = "vec_id bigint, embedding array<double>, score int, block int"
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    real = {i: v for i, v in rows if i in (0, 20, 1, 2, 3, 9)}
    want = brute(list(real), list(real.values()), [(q, real[q]) for q in (0, 20)])
    assert found(neighbours.search(frame, frame.where("vec_id % 20 = 0"))) == want
    assert neighbours.search(frame, frame.where("false")).count() == 0
    assert neighbours.search(frame.where("false"), frame).count() == 0
    alone = frame.where("vec_id = 0")
    assert neighbours.search(alone, alone).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_ties_go_to_smaller_ids(spark, k):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(30)], "vec_id bigint, embedding array<double>")
    have = found(neighbours.search(frame, frame.where("vec_id = 1"), k=k))
    assert [i for i, _ in have[1]] == [3, 5, 7][:k]


def test_copies_take_no_places(spark, monkeypatch):
    """A third of the rows is one vector and norms differ: pivots stay distinct, ties whole, and others are found."""
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "LEAST", 1)
    rng = np.random.default_rng(5)
    own = rng.normal(size=(1000, 64))
    own *= rng.uniform(0.8, 1.25, size=(1000, 1)) / np.linalg.norm(own, axis=1, keepdims=True)
    ids = rng.permutation(1500).tolist()
    vectors = own.tolist() + [own[0].tolist()] * 500
    near = [(5000 + i, (own[0] + 0.05 * rng.normal(size=64)).tolist()) for i in range(10)]
    asked = [(ids[0], vectors[0]), *near, *((ids[i], vectors[i]) for i in range(1, 40))]
    schema = "vec_id bigint, embedding array<double>"
    base, queries = spark.createDataFrame(list(zip(ids, vectors)), schema), spark.createDataFrame(asked, schema)
    vecs = neighbours.distinct(base.select("vec_id", base["embedding"].alias("v")), 21)
    assert vecs.count() == 1000 and len(np.unique(neighbours.pivots_of(vecs), axis=0)) == neighbours.PIVOTS
    have, want = found(neighbours.search(base, queries)), brute(ids, vectors, asked)
    copies = {ids[0], *ids[1000:]}
    for q, _ in asked:
        assert len(have[q]) == 20
        named = [i for i, _ in have[q] if i in copies]
        assert named == sorted(copies - {q})[: len(named)]
    assert np.mean([len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 20 for q, _ in asked]) >= 0.9
