import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import langid
from weft.llm.common import id_crc32, table

from .conftest import rows

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, PATH, "documents")
    return langid.train(docs.where(F.pmod(id_crc32(), F.lit(5)) != 0))


def test_held_out_accuracy(spark, model):
    docs = table(spark, PATH, "documents").where(F.pmod(id_crc32(), F.lit(5)) == 0)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 100 and (found["lang_pred"] == found["lang"]).mean() >= 0.98


def grams(text):
    """Packed n-grams of a text, one word at a time."""
    out, none = [], (1 << 21) - 1
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        marked = [0, *map(ord, word), 0]
        out += [c << 42 | none << 21 | none for c in marked[1:-1]]
        out += [a << 42 | b << 21 | none for a, b in zip(marked, marked[1:])]
        out += [a << 42 | b << 21 | c for a, b, c in zip(marked, marked[1:], marked[2:])]
    return out


@pytest.mark.parametrize("stretch", [1 << 20, 300])
def test_counts_and_filters_by_brute_force(spark, some_docs, monkeypatch, stretch):
    """N-grams are counted exactly; each is found in its languages' filters, and in few others."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    counts = {}
    for row in some_docs.collect():
        counts.setdefault(row.lang, Counter()).update(grams(row.text))
    assert {(r.lang, r.gram): r.n for r in langid.gram_counts(some_docs, "text", "lang").collect()} == {(x, g): n for x, c in counts.items() for g, n in c.items()}
    model = langid.train(some_docs)
    assert model.langs == sorted(counts)
    totals = {x: sum(c.values()) for x, c in counts.items()}
    every = sorted({g for c in counts.values() for g in c})
    found, false = model.masks(np.array(every))[:, 0], 0
    for i, g in enumerate(every):
        rate = {x: c[g] / totals[x] for x, c in counts.items() if c.get(g, 0) >= langid.MIN_COUNT}
        own = {x for x, r in rate.items() if r >= langid.MIN_SHARE * max(rate.values())}
        got = {x for j, x in enumerate(model.langs) if found[i] >> j & 1}
        assert own <= got
        false += len(got - own)
    assert false <= 0.01 * len(every) * len(model.langs) + 5
    texts = [r.text for r in some_docs.limit(20).collect()] + [None, "", "123 !", "ß"]
    votes = model.votes(texts)
    member = dict(zip(every, found))
    for text, vote in zip(texts, votes):
        own = grams(text or "")
        assert vote[0] == len(own)
        known = [g for g in own if g in member]
        if len(known) == len(own):
            assert vote[1:].tolist() == [sum(int(member[g]) >> j & 1 for g in own) for j in range(len(model.langs))]


def test_large_alphabets_are_counted_alike():
    rng = np.random.default_rng(3)
    text = "".join(chr(c) for c in rng.choice(np.r_[0x4E00:0x5200, 32], 5000))
    names, numbers = langid.counted(langid._stream([text]))
    assert dict(zip(names.tolist(), numbers.tolist())) == Counter(grams(text))


def test_more_languages_than_bits(spark):
    letters = "abcdefghij"
    docs = [(i, f"{letters[i % 10]}{letters[i // 10]}{letters[i % 10]} " * 5, f"x{i:02d}") for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = langid.train(frame)
    assert model.table.shape[1] == 2
    found = {r.doc_id: r.lang_pred for r in langid.identify(frame, model).collect()}
    assert sum(found[i] == f"x{i:02d}" for i in range(80)) >= 76


def test_votes_are_corrected_for_false_positives():
    model = langid.LanguageModel(["a", "b"], np.zeros((8, 1), np.int64), np.array([0.5, 0.0]))
    best, score = model.vote(np.array([10.0, 10.0]), np.array([[5.0, 3.0], [9.0, 3.0]]))
    assert best.tolist() == [1, 0] and score[0] == 1.0


def test_odd_rows(odd_docs, no_docs, model):
    found = langid.identify(odd_docs, model).collect()
    assert len(found) == len(rows())
    letters = {i: any(c.isalpha() for c in t or "") for i, t, *_ in rows()}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) and 0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found} <= {"und", *model.langs}
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"}
    assert langid.train(odd_docs).langs == ["de", "en", "fr"]
