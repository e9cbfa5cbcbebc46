"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of a text;
dynamic programming carries the best score and its number of pieces. Ties follow the
tokenizer's rule: starts are tried from left to right and a later one must be strictly
better, so of equal scores the path whose last piece starts first (the longest) stays. A
character that no single-character piece covers may be unknown, at ten less than the
worst score; adjacent unknowns are one piece, or their bytes if the vocabulary has them.

Pieces never cross a word boundary (``safe_cut``) in vocabularies of marked words, and
whole scores add up exactly, so words are solved alone and remembered; any other
vocabulary is solved over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import worker_store

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


@dataclass
class UnigramCounter:
    """``pieces``: (piece, score) in vocabulary order. ``bytes_known``: bytes of unknowns count one each."""

    pieces: list[tuple[str, float]]
    bytes_known: bool = True
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in self.pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in self.pieces}
        self.bytes_known = self.bytes_known and all(f"<0x{b:02X}>" in names for b in range(256))
        whole = all(float(s).is_integer() and abs(s) < 2**40 for _, s in self.pieces)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        self.safe_cut = whole and not crossing and self.bytes_known
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def solve(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of one stretch of text."""
        size, unknown = len(text), self.unknown
        best, count, loose = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)

        def close(at: int, top: float | None, pieces: int, single: bool) -> None:
            """Settle place ``at``, also by an unknown character where no piece is that character."""
            if not single:
                value = best[at - 1] + unknown
                if top is None or value > top:
                    top, loose[at] = value, True
                    if self.bytes_known:
                        pieces = count[at - 1] + len(text[at - 1].encode("utf-8", "replace"))
                    else:
                        pieces = count[at - 1] + (not loose[at - 1])
            best[at], count[at] = top, pieces

        at, top, pieces, single = 1, None, 0, False
        for last, (length, score) in self.automaton.iter(text):  # at each place the longest match comes first
            while at <= last:
                close(at, top, pieces, single)
                at, top, pieces, single = at + 1, None, 0, False
            value = best[at - length] + score
            if top is None or value > top:
                top, pieces = value, count[at - length] + 1
            single = single or length == 1
        while at <= size:
            close(at, top, pieces, single)
            at, top, pieces, single = at + 1, None, 0, False
        return best[size], count[size]

    def count(self, text: str | None) -> tuple[float, int]:
        """Score and number of pieces of a raw text: spaces become marks, and one leads."""
        if not text:
            return 0.0, 0
        text = text.replace(" ", MARK)
        text = text if text.startswith(MARK) else MARK + text
        if not self.safe_cut:
            return self.solve(text)
        known, score, number = self.known, 0.0, 0
        if len(known) > CACHE_WORDS:
            known.clear()
        for word, times in Counter(self.words(text)).items():
            got = known.get(word)
            if got is None:
                got = self.solve(word)
                if len(word) <= 64:
                    known[word] = got
            score += got[0] * times
            number += got[1] * times
        return score, number


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file; its scores serve as the unigram scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def _counter(path: str) -> UnigramCounter:
    """One per Python worker, for all the tasks that it runs."""
    store = worker_store()
    if ("unigram", path) not in store:
        store["unigram", path] = UnigramCounter(sentencepiece_pieces(path))
    return store["unigram", path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, score)`` per row; null and empty texts have 0 tokens and score 0.

    Repeated rows and ids are counted each; an empty table gives an empty table; other
    columns are ignored. A word longer than 64 characters is solved but not remembered.
    """

    def run(batches):
        for batch in batches:
            count = _counter(model_path).count
            rows = [count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([s for s, _ in rows], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
