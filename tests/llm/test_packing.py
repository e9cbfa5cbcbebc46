import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from weft.llm import packing
from weft.llm.queries import TOKENIZERS

from .conftest import rows

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_tokenizer_equals_the_library(library):
    rng, own = random.Random(1), packing.WordTokenizer(PATH, cache=2000)
    pick = [lambda: rng.randrange(1, 0x250), lambda: rng.randrange(1, 0x3000), lambda: rng.randrange(0x300, 0x370), lambda: 0x3A3, lambda: 0x130, lambda: 39, lambda: 32]
    texts = ["".join(chr(rng.choice(pick)()) for _ in range(60)) for _ in range(3000)]
    texts += ["it's we'LL don't 12345 ''s <|endoftext|> x", "", " \n ", "a b\x1cc\x85d"]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check(found, texts, library, size, **limits):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want[i].append((n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in p) for i, p in by_doc.items()} == {i: sorted(p) for i, p in want.items()}
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0] + [r.length for r in parts[:-1]]).tolist()
        assert sum(r.length for r in parts) <= size
        assert len(parts) <= limits.get("max_documents", size)
        assert sum(r.length**2 for r in parts) <= limits.get("max_attention", size**2)
    return len(by_sequence)


def test_documents(some_docs, library):
    texts = [(r.doc_id, r.text) for r in some_docs.collect()]
    found = packing.pack_documents(some_docs, PATH).collect()
    total = sum(r.length for r in found)
    assert check(found, texts, library, 4096) <= -(-total // 4096) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(some_docs, library, rule):
    texts = [(r.doc_id, r.text) for r in some_docs.collect()]
    limits = {"max_documents": 5, "max_attention": 512**2 - 40_000}
    pieces = packing.pieces(some_docs, PATH, max_tokens=400)
    found = packing.pack(pieces, max_tokens=400 + 112, weights=(1.0, 0.5, 0.5), rule=rule, block_pieces=300, **limits).collect()
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append(r.length)
    assert all(sum(x) <= 512 and len(x) <= 5 and sum(n * n for n in x) <= limits["max_attention"] for x in by.values())
    assert len(found) == pieces.count()


def test_best_fit_takes_the_fullest_sequence():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 4, 1]), np.array([10.0, 10, 100]), np.array([1.0, 0, 0]))
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 9]


def test_odd_rows(odd_docs, no_docs, library):
    found = packing.pack_documents(odd_docs, PATH).collect()
    check(found, [(i, t) for i, t, *_ in rows()], library, 4096)
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_piece_beyond_a_capacity(some_docs):
    with pytest.raises(ValueError):
        packing.pack(packing.pieces(some_docs, PATH), max_attention=10)


def test_copies_of_a_piece_are_in_different_sequences(spark):
    """Many copies, in one block and in several, with ids and without; nothing is lost."""
    rows = [(1, 0, 0, 10, 5)] * 40 + [(None, 0, 0, 10, 5)] * 40 + [(None, 0, 0, 10, 6)] * 20 + [(i, 0, 0, 10, 5) for i in range(2, 60)]
    found = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    for block_pieces in (1000, 30):
        out = packing.pack(found, max_tokens=100, block_pieces=block_pieces, copies_apart=True).collect()
        assert Counter((r.doc_id, r.ids_crc32) for r in out) == Counter((i, c) for i, *_, c in rows)
        held = Counter((r.sequence_id, r.doc_id, r.ids_crc32) for r in out)
        assert max(held.values()) == 1
        assert len({(r.sequence_id, r.offset) for r in out}) == len(rows) and all(r.offset + r.length <= 100 for r in out)


def test_a_null_id_does_not_fill_one_block(spark):
    found = spark.createDataFrame([(None, 0, 0, 10, 5)] * 4000, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack(found, max_tokens=100, block_pieces=500)
    assert out.select((F.col("sequence_id") / 2**32).cast("int").alias("block")).distinct().count() == 8
