import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weft.llm import queries, ranked

from .conftest import rows, sorted_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items, top=10):
    """Every document scored for every item."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    number = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * number // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in TERM.findall(lower(text)) if w in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "one TWO three"), (2, "word5 word6 und3"), (3, None), (4, ""), (5, "nowhere"), (6, "second second line"), (7, "ÄRGER é 7"), (None, "of its own")]


def test_terms():
    text = "Äb-c D9_é\x7fx\x00y{z}ABC w"
    assert ranked.term_counts(text.encode()) == Counter(x.encode() for x in TERM.findall(lower(text)))
    assert ranked.term_counts(None) == ranked.term_counts(b"") == Counter()


def test_long_texts_are_taken_apart_whole(monkeypatch):
    text = "alpha beta gamma-delta epsilon " * 50
    want = ranked.term_counts(text.encode())
    monkeypatch.setattr(ranked, "STRETCH", 7)
    assert ranked.term_counts(text.encode()) == want == Counter(x.encode() for x in TERM.findall(text))


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = [(r[0], r[1]) for r in rows()]
    assert sorted_rows(ranked.search(odd_docs, items)) == plain(docs, ITEMS)
    assert ranked.search(no_docs, items).count() == 0
    assert ranked.search(odd_docs, items.where("false")).count() == 0


@pytest.mark.parametrize("bucket", [8, 1 << 14])
def test_random_documents(spark, monkeypatch, bucket):
    """Ties, copies that make up a third, and several buckets and partitions."""
    monkeypatch.setattr(ranked, "BUCKET", bucket)
    dice = random.Random(5)
    word = lambda: f"w{int(dice.paretovariate(0.7)) % 60}"
    docs = [(i, " ".join(word() for _ in range(dice.randrange(40)))) for i in range(300)] + [(300 + i, "w1 w2 w3 w3 w40") for i in range(150)]
    items = [(i, " ".join(word() for _ in range(dice.randrange(1, 9)))) for i in range(25)] + [(99, "w1 w3")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    found = ranked.search(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted_rows(found) == plain(docs, items)


def test_blocks_of_queries(spark, some_docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted_rows(ranked.search(some_docs, items))
    monkeypatch.setattr(ranked, "BLOCK_CHARS", 2000)
    assert sorted_rows(ranked.search(some_docs, items)) == want


def test_bounds_hold():
    """A bucket that is left out, and documents that are, score below the query's least."""
    dice = np.random.default_rng(2)
    sizes = dice.integers(1, 12, 200)
    ids = np.concatenate([dice.choice(30, s, replace=False) for s in sizes])
    values = dice.integers(1, 1000, len(ids))
    lengths = np.sqrt(np.add.reduceat(values.astype(float) ** 2, np.cumsum(sizes) - sizes))
    bucket = ranked.Bucket(np.arange(200), np.zeros(200, bool), lengths, sizes, ids, values, 30)
    owner = np.repeat(np.arange(200), sizes)
    left_out = pruned = 0
    for least in (1, 100_000, 1_000_000, 3_000_000, 9_000_000):
        for _ in range(20):
            terms = dice.choice(30, 6, replace=False)
            query = ranked.Query(terms, dice.integers(1, 3000, 6), 10, least)
            dense = np.zeros(30, np.int64)
            dense[query.ids] = query.weights
            scores = np.bincount(owner, dense[ids] * values, 200)
            focus = bucket.focus(query)
            found = bucket.survivors(query, focus) if focus else np.empty(0, int)
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
            left_out += focus == 0
            pruned += 0 < len(found) < np.count_nonzero(scores)
    assert left_out and pruned


def test_registered_query(spark, some_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = queries.op12_ranked(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    docs = [tuple(r) for r in some_docs.select("doc_id", "text").collect()]
    assert sorted_rows(found) == plain(docs, [tuple(r) for r in items.collect()])
