"""Vector best-fit packing of documents into sequences.

Documents are tokenized and cut where they are; what is shuffled is one short row per
piece. Pieces are dealt by hash into blocks of about ``block_pieces``, each packed by one
task in bounded memory: longest first, every piece into the open sequence that it fits in
under all capacities (tokens, documents, attention cost = sum of squared lengths) and
that its rule rates best. A block ends with about one sequence that is not full, which is
what blocks cost against packing everything in one place.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept, worker_store

MAX_TOKENS = 4096
BLOCK_PIECES = 8192
END_ID = 1
CACHE_WORDS = 400_000

#: Fixed value: the pattern by which the tokenizer file splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of a byte-level tokenizer that drops white space and never merges across pre-tokens.

    White space splits a text into stretches; each distinct one is normalised (NFC, lower
    case), split into pre-tokens and merged by the library's model once, and remembered as
    bytes. The memory is emptied when it holds ``cache`` stretches.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.cache, self.known = cache, {}
        self.split = regex.compile(SPLIT).findall
        self.letters = byte_letters()
        # texts with these go to the library whole: special tokens; control characters that only
        # Python takes for white space; and a capital whose lower case ends in a combining mark
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([*map(re.escape, special), "[\x1c-\x1f\u0130]"])).search

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts, known = text.split(), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.cache:
                known.clear()
            for part in set(parts).difference(known):
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                words = (w.encode().decode("latin-1").translate(self.letters) for w in self.split(plain.lower()))
                known[part] = b"".join(token.id.to_bytes(4, "little") for w in words for token in self.merge(w))
            return b"".join(map(known.__getitem__, parts))


def byte_letters() -> dict[int, str]:
    """The visible character by which byte-level vocabularies write each byte."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in seen else next(hidden)) for b in range(256)}


def _tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, for all the tasks that it runs."""
    store = worker_store()
    if path not in store:
        store[path] = WordTokenizer(path)
    return store[path]


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents cut into pieces of at most ``max_tokens``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = _tokenizer(tokenizer).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                step = 4 * max_tokens
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


WEIGHTS = (1.0, 0.5, 0.5)  # of tokens, documents and attention cost in the rule


def best_fit(
    lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm", same: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` descend. ``capacity``: tokens, documents, attention cost.

    ``same[i]`` says that item i is a copy of the one before it; copies never share a bin.

    ``rule``: "norm" takes the bin with the smallest weighted norm of what would be left,
    "dot" the one with the largest weighted product of item and room. Ties: oldest bin.
    """
    number = len(lengths)
    bins, offsets = np.empty(number, np.int64), np.empty(number, np.int64)
    room, names, open_, made = np.empty((256, 3)), np.empty(256, np.int64), 0, 0
    least = lengths[-1] if number else 0
    scale = weights / capacity**2
    run = 0  # where the present run of copies begins
    for i, length in enumerate(lengths):
        item = np.array([length, 1, length * length], float)
        at = -1
        if same is None or not same[i]:
            run = i
        if open_ and length < capacity[0]:
            left = room[:open_] - item
            fits = (left >= 0).all(axis=1)
            if run < i:
                fits &= ~np.isin(names[:open_], bins[run:i])
            if fits.any():
                value = (left * left) @ scale if rule == "norm" else -(room[:open_] @ (item * scale))
                value[~fits] = np.inf
                best = np.flatnonzero(value == value.min())
                at = best[np.argmin(names[best])]
        if at < 0:
            if open_ == len(room):
                room, names = np.resize(room, (2 * open_, 3)), np.resize(names, 2 * open_)
            at, room[open_], names[open_] = open_, capacity, made
            open_, made = open_ + 1, made + 1
        bins[i], offsets[i] = names[at], capacity[0] - room[at, 0]
        room[at] -= item
        if (room[at] < (least, 1, least * least)).any():  # no item left can go in
            open_ -= 1
            room[at], names[at] = room[open_], names[open_]
    return bins, offsets


def pack(
    found: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    block_pieces: int = BLOCK_PIECES,
    copies_apart: bool = False,
) -> DataFrame:
    """``found`` (of :func:`pieces`) plus ``sequence_id`` and ``offset``, gapless from 0.

    Capacities that are not given cannot bind: as many documents as tokens, and the cost of
    one piece that fills a sequence. ``weights`` rate the three capacities in the rule.
    Pieces are dealt to blocks by what they are and their place in the written table, so
    that neither repeated nor null ids make a block large. With ``copies_apart`` no sequence
    holds a piece (id, number, place and tokens) twice, which takes more sequences if need be.
    """
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or max_tokens**2], float)
    found = kept(found, "pieces")
    longest = found.agg(F.count("*"), F.max("length")).first()
    if (longest[1] or 0) > max_tokens or (longest[1] or 0) ** 2 > capacity[2]:
        raise ValueError("a piece is beyond a capacity of a sequence")
    blocks = max(1, -(-longest[0] // block_pieces))

    names = ["length", "doc_id", "piece", "start", "ids_crc32"]

    def run(key, frame):
        frame = frame.sort_values(names, ascending=[False, True, True, True, True], ignore_index=True)
        same = frame.duplicated(names).to_numpy() if copies_apart else None  # copies follow one another: all keys are sorted
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, np.array(weights), rule, same)
        return frame.drop(columns="block").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    block = F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return found.select("*", block).groupBy("block").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece, the end token alone. Only documents longer than a
    sequence are cut. Repeated rows are packed each; ids may be null or repeat. An empty
    table gives an empty one; other columns are ignored.
    """
    size = limits.get("max_tokens", MAX_TOKENS)
    return pack(pieces(docs, tokenizer, id_col, text_col, size), **limits)
