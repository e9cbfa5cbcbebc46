import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import quality
from weft.llm.common import id_crc32, table

from .conftest import rows

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    labels = table(spark, PATH, "labels").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    return quality.train(table(spark, PATH, "documents"), labels)


def test_held_out_accuracy(spark, model):
    scored = quality.score_documents(table(spark, PATH, "documents"), model)
    held = scored.where(F.pmod(id_crc32(), F.lit(4)) == 2).join(table(spark, PATH, "labels"), "doc_id").toPandas()
    assert len(held) > 50 and set(held["quality"]) == {0, 1}
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    clean = held[held["quality"] == 1]
    assert (clean["predicted"] == 1).mean() >= 0.98
    assert held["score"].between(0, 1).all()


def test_word_vectors_by_brute_force(spark, some_docs):
    """Sums over neighbours, one pair at a time."""
    few = some_docs.limit(20).cache()
    places, signs = quality.index_vectors()
    want, buckets = np.zeros((quality.BUCKETS, quality.DIM)), quality.Buckets()
    for row in few.collect():
        words = buckets.of(row.text)
        for a, b in zip(words, words[1:]):
            want[a, places[b]] += signs[b]
            want[b, places[a]] += signs[a]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    for b in range(quality.BUCKETS):
        want[b, places[b]] += signs[b] / 2
    assert np.allclose(quality.word_vectors(few), want, atol=1e-6)


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, quality.DIM))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)  # labels as noisy as their probability says
    net = quality.fit(x, y)
    p = net.probability(x)
    assert 1.0 < net.temperature <= 8 and abs(p.mean() - y.mean()) < 0.1


def test_few_labels(spark, some_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score_documents(some_docs, quality.train(some_docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 1), (3, 1, 1), (999_999, 0, 0)], none.schema)
    assert [tuple(r) for r in quality.labelled_sample(odd, "doc_id", "quality", 10).collect() if r[0] < 1000] == [(3, 1)]


def test_odd_rows(odd_docs, no_docs, model):
    found = quality.score_documents(odd_docs, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, *_ in rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert quality.accepted(odd_docs, model).columns == odd_docs.columns
    assert quality.score_documents(no_docs, model).count() == 0
    assert quality.train(no_docs, no_docs.sparkSession.createDataFrame([], "doc_id bigint, quality int")).table.shape == (quality.BUCKETS, quality.DIM)
