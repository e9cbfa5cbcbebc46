import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weft.llm import collocations, queries

from .conftest import rows, sorted_rows


def plain(docs, least, longest=5, percent=100, top=2000):
    """``(lang, rank, phrase, a, l, r, n, score)`` in plain Python."""
    total, counts = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= least}
        held = set()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= percent * frequent[p[i : i + size]]:
                        held.add(p[i : i + size])
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in held:
                cuts = [(1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                phrase = " ".join(p)
                scored.append(((-score, -a, phrase.encode()), (phrase, a, left, right, total[lang], score)))
        out += [(lang, k, *x) for k, (_, x) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def result(docs, **how):
    return sorted_rows(collocations.collocations(docs, **how).drop("doc_id"))


@pytest.mark.parametrize("least", [1, 2, 5])
def test_odd_rows(odd_docs, least):
    assert result(odd_docs, min_count=least) == plain([(r[1], r[2]) for r in rows()], least)


def test_empty_table(no_docs):
    assert collocations.collocations(no_docs).count() == 0


@pytest.mark.parametrize("how", [{"min_count": 3}, {"min_count": 4, "contained_percent": 60, "top": 7}, {"min_count": 3, "longest": 3}])
def test_random_texts(spark, monkeypatch, how):
    """Pieces, runs of blanks, bytes 0, words beyond ASCII, and stretches much shorter than the table."""
    monkeypatch.setattr(collocations, "STRETCH", 400)
    dice = random.Random(3)
    words = ["a", "B", "aa", "Ä", "é", "\0", "a\0", "the", "of", "x-y", "日本", "longer-word-of-many-bytes", " "]
    join = [" ", " ", " ", "  ", "\t", " \t ", ". ", "\n", ",", "?!"]
    docs = [("".join(dice.choice(words) + dice.choice(join) for _ in range(dice.randrange(40))), dice.choice(["en", "de", None])) for _ in range(200)]
    docs += [("the same words in many copies of a text", "en")] * 70
    frame = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string").repartition(3)
    names = {"min_count": "least", "contained_percent": "percent"}
    want = plain(docs, **{names.get(k, k): v for k, v in how.items()})
    assert result(frame, **how) == want and len(want) > 5


def test_colliding_fingerprints(spark, monkeypatch):
    """Counts are by text, even where all fingerprints are equal."""
    monkeypatch.setattr(collocations, "mixed", lambda values: values & np.uint64(1))
    docs = [("one two three one two three four", "en"), ("two three four five", "de"), ("one two one two", None)] * 3
    frame = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string").repartition(2)
    assert result(frame, min_count=3) == plain(docs, 3)


def test_pointers(spark):
    docs = [(9, "big data tools", "en"), (4, "some big data", "en"), (None, "big data", "en"), (6, "nothing", "en")]
    found = collocations.frequent_phrases(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), min_count=2)
    assert {(r.phrase, r.n, r.doc_id) for r in found.where("words > 0").collect()} == {("big", 3, 4), ("data", 3, 4), ("big data", 3, 4)}


def test_long_text_in_stretches(spark, monkeypatch):
    text = " ".join(f"w{i % 7} x{i % 5}" + ("." if i % 11 == 0 else "") for i in range(3000))
    frame = spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(collocations, "STRETCH", 500)
    assert result(frame, min_count=20) == plain([(text, "en")], 20)


def test_score_is_exact(spark):
    cases = [(10**15, 3 * 10**15, 7, 11), (123456789012345, 998877665544332, 123456789012346, 987654321), (100, 10**6, 100, 100)]
    cases = [(a, n, left, right) for a, n, left, right in cases if 1000 * a * n // (left * right) < 2**63]
    frame = spark.createDataFrame(cases, "a bigint, n bigint, l bigint, r bigint").select("*", collocations._score().alias("score"))
    assert [r.score for r in frame.collect()] == [1000 * a * n // (left * right) for a, n, left, right in cases]


def test_registered_query(spark, some_docs, monkeypatch):
    found = queries.op11_collocations(spark, "/root/testdata/sf0.001")
    kinds = dict(found.dtypes)
    assert kinds.pop("lang") == kinds.pop("phrase") == "string" and set(kinds) == {"rank", "a", "l", "r", "n", "score"} and set(kinds.values()) == {"bigint"}
    docs = [tuple(r) for r in some_docs.select("text", "lang").collect()]
    assert sorted_rows(found) == plain(docs, 100)
    assert result(some_docs, min_count=5, top=300) == plain(docs, 5, top=300)
