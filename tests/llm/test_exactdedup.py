import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weft.llm import exactdedup, queries

from .conftest import rows, sorted_rows


def plain(docs):
    """``{text: (largest id, size)}``; null ids are smaller than all others."""
    groups = defaultdict(list)
    for i, text in docs:
        groups[text or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(found, docs):
    want = plain(docs)
    by_sha = {hashlib.sha256(t.encode()).digest(): (t, *v) for t, v in want.items()}
    seen, stay = [], defaultdict(int)
    for r in found.collect():
        text, keep, size = by_sha[bytes(r.sha)]
        assert (r.keep_id, r.group_size) == (keep, size)
        assert not r.kept or r.doc_id == keep
        stay[text] += r.kept
        seen.append((r.doc_id, text))
    assert sorted(seen, key=repr) == sorted(((i, t or "") for i, t in docs), key=repr)
    assert all(n == 1 for n in stay.values()) and len(stay) == len(want)


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
@pytest.mark.parametrize("hot_rows", [1000, 0])
def test_odd_rows(odd_docs, digest_bytes, hot_rows, monkeypatch):
    """Also where different texts share a digest, and where all digests are salted."""
    monkeypatch.setattr(exactdedup, "HOT_GROUPS", 1000)
    found = exactdedup.duplicate_groups(odd_docs, digest_bytes=digest_bytes, hot_rows=hot_rows)
    check(found, [(r[0], r[1]) for r in rows()])


def test_large_group_over_many_tasks(spark):
    docs = [(i, "the copied text" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(13)
    check(exactdedup.duplicate_groups(frame, salts=3, hot_rows=20), docs)


def test_repeated_ids_keep_one_row(spark):
    docs = [(7, "same")] * 5 + [(None, "none")] * 3 + [(1, "same"), (7, "other")]
    check(exactdedup.duplicate_groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)), docs)


def test_empty_table(no_docs):
    assert exactdedup.duplicate_groups(no_docs).count() == 0
    assert exactdedup.drop_copies(no_docs).columns == no_docs.columns


def test_drop_copies(odd_docs):
    kept = exactdedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {(keep, text) for text, (keep, _) in plain([(r[0], r[1]) for r in rows()]).items()}
    assert {(r.doc_id, r.text or "") for r in kept.collect()} == want and kept.count() == len(want)


def test_normalised(spark):
    docs = spark.createDataFrame([(1, " A b"), (2, "a  B "), (3, "ab")], "doc_id bigint, text string")
    fold = lambda text: F.lower(F.regexp_replace(F.trim(text), " +", " "))
    found = exactdedup.duplicate_groups(docs, normalise=fold)
    assert sorted_rows(found.select("doc_id", "keep_id", "group_size", "kept")) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_registered_query(spark):
    found = queries.op13_exact_dedup(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = plain(docs)
    expected = [(i, *want[t or ""], i == want[t or ""][0], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs]
    assert sorted_rows(found) == sorted(expected, key=repr)


def test_files_are_freed(some_docs, spark):
    import os

    from weft.session import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    exactdedup.duplicate_groups(some_docs).count()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"found"}
