import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers
from weft.llm import viterbi
from weft.llm.queries import TOKENIZERS

from .conftest import rows

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


def library(pieces, bytes_known):
    tokenizer = Tokenizer(models.Unigram(pieces, 0, bytes_known))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def random_texts(rng, number):
    pick = [lambda: 32, lambda: 32, lambda: 10, lambda: rng.randrange(33, 127), lambda: rng.randrange(33, 0x3000), lambda: rng.randrange(0x4E00, 0x9FFF), lambda: 0x2581]
    return ["".join(chr(rng.choice(pick)()) for _ in range(rng.randrange(0, 60))) for _ in range(number)]


def test_public_vocabulary(some_docs):
    pieces = viterbi.sentencepiece_pieces(PATH)
    own, want = viterbi.UnigramCounter(pieces), library(pieces, True)
    assert own.safe_cut
    for text in random_texts(random.Random(2), 1500) + [r.text for r in some_docs.limit(60).collect()]:
        assert own.count(text)[1] == want(text)


@pytest.mark.parametrize("whole", [True, False])
def test_ties_and_unknowns(whole):
    """Small vocabularies with many equal scores, with and without fused unknowns."""
    rng = random.Random(5)
    for _ in range(40):
        names = {"".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
        score = (lambda: -float(rng.randrange(1, 4))) if whole else (lambda: -rng.choice([0.1, 0.2, 0.3, 0.7]))
        pieces = [("<unk>", -5.0)] + [(n, score()) for n in sorted(names)]
        own, want = viterbi.UnigramCounter(pieces), library(pieces, False)
        for _ in range(60):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 14)))
            assert own.count(text)[1] == want(text), (pieces, text)


def test_score_by_brute_force():
    pieces = [("<unk>", -9.0), ("a", -2.0), ("ab", -3.0), ("b", -2.0), ("abc", -4.5), ("c", -1.0), ("▁", 0.0)]
    table, unknown = dict(pieces), -19.0

    def best(text):
        if not text:
            return 0.0
        options = [s + best(text[len(p) :]) for p, s in table.items() if text.startswith(p)]
        if text[0] not in table:
            options.append(unknown + best(text[1:]))
        return max(options)

    own, rng = viterbi.UnigramCounter(pieces), random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abcx") for _ in range(9))
        assert own.solve(text)[0] == best(text)


def test_odd_rows(odd_docs, no_docs):
    want = library(viterbi.sentencepiece_pieces(PATH), True)
    found = sorted(((r.doc_id, r.n_tokens) for r in viterbi.count_tokens(odd_docs, PATH).collect()), key=repr)
    assert found == sorted(((i, want(t) if t else 0) for i, t, *_ in rows()), key=repr)
    assert viterbi.count_tokens(no_docs, PATH).count() == 0
