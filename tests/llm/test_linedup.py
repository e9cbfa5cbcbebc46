from collections import Counter, defaultdict

from weft.llm import linedup

from .conftest import rows, sorted_rows


def plain(docs, ratio, least):
    pages, counts = Counter(), defaultdict(Counter)
    for _, text, source in docs:
        pages[source] += 1
        counts[source].update({x for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for i, text, source in docs:
        bad = {x for x, n in counts[source].items() if n >= least and n / pages[source] > ratio}
        out.append((i, None if text is None else "\n".join(x for x in text.split("\n") if x not in bad), source))
    return sorted(out, key=repr)


def test_documents(some_docs):
    docs = [tuple(r) for r in some_docs.select("doc_id", "text", "source").collect()]
    for ratio, least in ((0.08, 3), (0.5, 1), (0.05, 1)):
        found = linedup.drop_boilerplate(some_docs, ratio=ratio, min_pages=least).select("doc_id", "text", "source")
        want = plain(docs, ratio, least)
        assert sorted_rows(found) == want
    assert want != sorted(docs, key=repr)


def test_odd_rows(odd_docs, no_docs):
    want = plain([(i, t, s) for i, t, _, s, _ in rows()], 0.2, 2)
    found = linedup.drop_boilerplate(odd_docs, ratio=0.2, min_pages=2)
    assert found.columns == odd_docs.columns
    assert sorted_rows(found.select("doc_id", "text", "source")) == want
    assert linedup.drop_boilerplate(no_docs).count() == 0


def test_without_broadcast(odd_docs, monkeypatch):
    monkeypatch.setattr(linedup, "BROADCAST_LINES", -1)
    want = plain([(i, t, s) for i, t, _, s, _ in rows()], 0.2, 2)
    assert sorted_rows(linedup.drop_boilerplate(odd_docs, ratio=0.2, min_pages=2).select("doc_id", "text", "source")) == want


def test_copies_of_a_page_are_one_vote(spark):
    """A third of a source is one page: it keeps its own lines and loses the line that all pages share."""
    texts = [f"menu\nfirst line of {i}\nlast line of {i}" for i in range(40)] + ["menu\na copied line\nand another"] * 20
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    found = linedup.drop_boilerplate(docs, copies_vote=False)
    assert [r.text for r in found.orderBy("doc_id").collect()] == [t.removeprefix("menu\n") for t in texts]
    assert {r["pages"]: r["total"] for r in linedup.boilerplate(docs, copies_vote=False).collect()} == {41: 41}


def test_the_pipeline_keeps_copied_pages(spark):
    import corpus_pipeline

    texts = [f"line of {i}" for i in range(20)] + ["a copied line"] * 10
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint")
    assert [r.text for r in corpus_pipeline.without_boilerplate(spark, docs, "").orderBy("doc_id").collect()] == texts
