"""The pipeline, stage by stage, each against a plain version over its own input."""

import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F
from weft.llm import mixing, quality, simhash
from weft.llm.common import kept, table
from weft.llm.queries import MIX, TOKENIZERS

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402

from . import test_linedup, test_mixing, test_packing, test_simhash  # noqa: E402

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, found = table(spark, PATH, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out = kept(stage(spark, docs, PATH), "test")
        found.append((docs, out))
        docs = out
    return found


def test_columns(stages, spark):
    columns = table(spark, PATH, "documents").columns
    assert [o.columns == columns for _, o in stages] == [True] * 4 + [False]
    assert all(o.schema["n_chars"].dataType == i.schema["n_chars"].dataType for i, o in stages[:4])


def test_quality_stage(stages, spark):
    docs, out = stages[0]
    model = quality.train(docs, table(spark, PATH, "labels"))
    passed = {r.doc_id for r in quality.score_documents(docs, model).collect() if r.score >= 0.7}
    assert {r.doc_id for r in out.collect()} == passed and 0 < len(passed) < docs.count()


def test_line_stage(stages):
    docs, out = stages[1]
    want = test_linedup.plain([(r.doc_id, r.text, r.source) for r in docs.collect()], 0.08, 3)
    rows = out.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in rows), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_near_dedup_stage(stages):
    docs, out = stages[2]
    want = {c for _, _, c in test_simhash.expected([(r.doc_id, r.text) for r in docs.collect()])}
    assert Counter(r.doc_id for r in out.collect()) == Counter(want)


def test_mixing_stage(stages):
    docs, out = stages[3]
    want = test_mixing.plain([(r.doc_id, r.text, r.source) for r in docs.collect()], MIX["max_repeats"], MIX["target_entropy"])
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, *_ in want)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in out.collect())


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    docs, out = stages[4]
    library = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    found = out.collect()
    total = sum(r.length for r in found)
    assert test_packing.check(found, [(r.doc_id, r.text) for r in docs.collect()], library, 4096) <= -(-total // 4096) + 2
    assert max(Counter((r.sequence_id, r.doc_id, r.piece, r.ids_crc32) for r in found).values()) == 1


def test_run_is_the_stages(stages, spark):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, PATH).collect())) == Counter(map(key, stages[-1][1].collect()))


def test_near_dedup_stage_on_odd_rows(odd_docs, no_docs, spark):
    out = corpus_pipeline.one_of_each(spark, odd_docs, PATH)
    assert out.columns == odd_docs.columns
    roots = {tuple(r)[0] for r in simhash.near_duplicates(odd_docs).select("root").collect()}
    of = {(r.doc_id, r.text_hash): r.root for r in simhash.near_duplicates(odd_docs).collect()}
    rows = out.withColumn("hash", F.xxhash64("text")).collect()
    assert Counter(of[r.doc_id, r.hash] for r in rows) == Counter(roots)
    assert {r.text for r in rows if r.doc_id == 4} == {"one two three four\nsecond line", "another text of the same id"}
    for stage in (corpus_pipeline.without_boilerplate, corpus_pipeline.one_of_each, corpus_pipeline.mixed):
        assert stage(spark, no_docs, PATH).count() == 0


def test_mixing_stage_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, 3), (2, None, "x", 0), (3, "c " * 5000, "x", 1)], "doc_id bigint, text string, source string, _times int")
    out = corpus_pipeline.mixed(spark, docs, PATH)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3}
    assert mixing.mix(docs).count() == out.count()


def test_rows_without_id_keep_one_of_each_group(spark):
    words = [" ".join(f"{a}{i}" for i in range(30)) for a in ("red", "blue", "green")]
    rows = [(None, words[0]), (None, words[0]), (None, words[1]), (9, words[2]), (2, words[2]), (9, words[2] + " "), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, PATH).collect()), key=repr)
    assert [x for x in out if x[0] is None] == [(None, words[1]), (None, words[0])]
    assert [x for x in out if x[0] is not None] == [(2, ""), (2, words[2])]


def test_a_repeated_id_does_not_bring_its_near_copy_back(spark):
    words = [" ".join(f"{a}{i}" for i in range(30)) for a in ("red", "blue")]
    docs = spark.createDataFrame([(1, words[0]), (5, words[0]), (5, words[1])], "doc_id bigint, text string")
    out = sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, PATH).collect())
    assert out == [(1, words[0]), (5, words[1])]


def test_mixing_stage_keeps_repeated_rows_apart(spark):
    rows = [(1, "a b", "x"), (1, "c d", "x"), (1, "c d", "x"), (None, "e f", "y"), (None, "g h i", "y"), (2, "j " * 40, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(2)
    out = corpus_pipeline.mixed(spark, docs, PATH)
    want = Counter((r.doc_id, r.source, r.tokens) for r in mixing.mix(docs, **MIX).collect())
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source, len(r.text.split()) + 1) for r in out.collect()) == want
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, t) for i, t, _ in rows}
