"""Phrase collocations by Rabin-Karp fingerprints of all n-grams.

A stretch of text becomes one array of bytes in which a blank follows each word. Prefix sums
of ``byte * BASE^place`` modulo 2^64 give the fingerprint of any run of words by one
subtraction, so the n-grams of every size cost a few numpy operations each.

N-grams are counted size by size. One can only be frequent if both n-grams of one word less
inside it are, so each size emits fingerprints of those alone, combined per stretch, per task
and over the shuffle. The frequent ones set bits of a filter whose size is bounded; what it
lets through by mistake costs a row and changes nothing.

Equal fingerprints may still be different phrases. A last pass over the texts takes, in every
stretch, one pointer to each fingerprint that passed, compares all other occurrences with the
text there byte by byte, and sends one row per *different text* with its count and a document
that holds it. Those rows are summed by text: counts are exact, and only phrases whose
fingerprint is frequent are ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import forget, kept, worker_store

MIN_COUNT = 100
LONGEST = 5
CONTAINED_PERCENT = 100
TOP = 2000
UNKNOWN = "und"
STRETCH = 1 << 22  # bytes handled at once
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
FILTER_BITS = 16  # per frequent fingerprint
MOST_BITS = 1 << 28  # of a filter
SALTS = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD, _BLANK, _END = 0, 1, 2
_KIND = np.array([_BLANK if c in b" \t" else _END if c in b".,;:!?\n\v\f\r" else _WORD for c in range(256)], np.uint8)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE^i`` and ``BASE^-i`` modulo 2^64 for at least ``size`` places, kept by the worker."""
    store = worker_store()
    if len(store.get("powers", [()])[0]) < size:
        found = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(max(size, STRETCH + (STRETCH >> 3)), base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        store["powers"] = tuple(found)
    return store["powers"]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits can number the slots of a filter."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Stretch:
    """Words of some texts: ``starts`` and ``ends`` in ``flat``, the ``piece`` and the ``owner`` (number of the text) of each."""

    def __init__(self, parts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join([*parts, b""]).translate(_LOWER), np.uint8)
        kind = _KIND[raw]
        word = kind == _WORD
        after = np.zeros(len(raw), bool)
        after[1:] = word[:-1] & ~word[1:]  # the place behind each word, taken by one blank
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = np.flatnonzero(first)
        self.piece = np.cumsum(kind == _END, dtype=np.int32)[at]
        taken = word | after
        self.flat = np.where(word, raw, np.uint8(32))[taken]
        self.ends = np.flatnonzero(after[taken])
        self.starts = np.concatenate([[0], self.ends + 1])[:-1]
        texts = np.cumsum([len(p) + 1 for p in parts])
        self.owner = np.searchsorted(texts, at, "right")
        seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), seed=1) for lang in set(langs)}
        self.seed = np.array([seeds[lang] for lang in langs], np.uint64)[self.owner]
        up, self.down = powers(len(self.flat) + 1)
        self.sums = np.zeros(len(self.flat) + 1, np.uint64)
        terms = self.sums[1:]
        terms += self.flat
        terms += np.uint64(1)  # so that a byte 0 counts
        terms *= up[: len(terms)]
        np.cumsum(terms, out=terms)

    def places(self, size: int) -> np.ndarray:
        """Words at which an n-gram of ``size`` words starts within its piece."""
        last = len(self.starts) - size + 1
        return np.flatnonzero(self.piece[:last] == self.piece[size - 1 :]) if last > 0 else np.empty(0, np.int64)

    def fingerprints(self, places: np.ndarray, size: int) -> np.ndarray:
        start, end = self.starts[places], self.ends[places + size - 1]
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] ^ self.seed[places])

    def phrase(self, place: int, size: int) -> bytes:
        return self.flat[self.starts[place] : self.ends[place + size - 1]].tobytes()

    def like(self, places: np.ndarray, models: np.ndarray, size: int) -> np.ndarray:
        """Whether the n-gram at each place has the bytes and the language of the one at ``models``."""
        start, length = self.starts[places], self.ends[places + size - 1] - self.starts[places]
        other = self.starts[models]
        same = (length == self.ends[models + size - 1] - other) & (self.seed[places] == self.seed[models])
        padded = np.concatenate([self.flat, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.flat) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        left = np.flatnonzero(same)
        for at in range(0, int(length.max(initial=0)), 8):
            left = left[length[left] > at]
            keep = np.minimum(length[left] - at, 8).astype(np.uint64) * np.uint64(8)
            mask = np.where(keep < 64, (np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
            equal = (eight[start[left] + at] ^ eight[other[left] + at]) & mask == 0
            same[left[~equal]] = False
            left = left[equal]
        return same


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in stretches that end where a piece ends; without such a place, it stays whole."""
    at = 0
    while len(text) - at > STRETCH:
        near = np.frombuffer(text, np.uint8, offset=at + STRETCH)
        step, end = 1 << 16, -1
        for i in range(0, len(near), step):
            found = np.flatnonzero(_KIND[near[i : i + step]] == _END)
            if len(found):
                end = at + STRETCH + i + int(found[0])
                break
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def stretches(batches) -> Iterator[tuple[Stretch, list, list[str]]]:
    """Texts of Arrow batches ``(doc_id, lang, text)``, a bounded number of bytes at a time, with
    the id and the language of each part."""
    parts, ids, langs, size = [], [], [], 0
    for batch in batches:
        for key, lang, text in zip(*batch.columns):
            for part in _cut(text.as_py()):
                parts.append(part)
                ids.append(key.as_py())
                langs.append(lang.as_py())
                size += len(part) + 1
                if size >= STRETCH:
                    yield Stretch(parts, langs), ids, langs
                    parts, ids, langs, size = [], [], [], 0
    if parts:
        yield Stretch(parts, langs), ids, langs


def passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the filter has the bit of each fingerprint."""
    slot = prints & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bits of the frequent fingerprints; the words of the filter, of bounded number, reach the driver."""
    bits = 1 << 16
    while bits < min(MOST_BITS, FILTER_BITS * frequent.count()):
        bits *= 2
    slot = F.col("print").bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(slot, 6).alias("word")
    bit = F.expr(f"shiftleft(1L, CAST((print & {bits - 1}) & 63 AS INT))")
    words = frequent.groupBy(word).agg(F.bit_or(bit).alias("set")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words["word"].to_numpy()] = words["set"].to_numpy()
    return found.view(np.uint64)


def _counted(rows: DataFrame, size: int, shorter) -> DataFrame:
    """``(print, n)``: fingerprints of the n-grams whose two shorter ones pass, and how often they occur."""

    def run(batches):
        for stretch, _, _ in stretches(batches):
            places = stretch.places(size)
            if size > 1:
                inside = stretch.places(size - 1)
                known = np.zeros(len(stretch.starts) + 1, bool)
                known[inside] = passes(shorter.value, stretch.fingerprints(inside, size - 1))
                places = places[known[places] & known[places + 1]]
            prints, numbers = np.unique(stretch.fingerprints(places, size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(numbers)], ["print", "n"])

    return rows.mapInArrow(run, "print bigint, n bigint").groupBy("print").agg(F.sum("n").alias("n"))


def _written_out(rows: DataFrame, filters: list) -> DataFrame:
    """``(lang, words, print, phrase, n, doc_id)`` per stretch: n-grams that pass, by their text.

    A row of 0 words carries the number of words of a language.
    """

    def run(batches):
        for stretch, ids, langs in stretches(batches):
            found = {x: [] for x in ("owner", "words", "print", "phrase", "n")}
            owners, numbers = np.unique(stretch.owner, return_counts=True)
            for owner, number in zip(owners.tolist(), numbers.tolist()):
                for column, value in zip(found.values(), (owner, 0, 0, b"", number)):
                    column.append(value)
            for size, bits in enumerate(filters, 1):
                places = stretch.places(size)
                prints = stretch.fingerprints(places, size)
                passed = passes(bits.value, prints)
                places, prints = places[passed], prints[passed]
                while len(places):  # once, unless different texts share a fingerprint
                    names, pointer, group = np.unique(prints, return_index=True, return_inverse=True)
                    pointer = places[pointer]
                    same = stretch.like(places, pointer[group], size)
                    found["owner"] += stretch.owner[pointer].tolist()
                    found["words"] += [size] * len(names)
                    found["print"] += names.view(np.int64).tolist()
                    found["phrase"] += [stretch.phrase(p, size) for p in pointer.tolist()]
                    found["n"] += np.bincount(group[same], minlength=len(names)).tolist()
                    places, prints = places[~same], prints[~same]
            owner = found.pop("owner")
            columns = [pa.array([langs[i] for i in owner], pa.string()), pa.array(found["words"], pa.int32()), pa.array(found["print"], pa.int64())]
            columns += [pa.array(found["phrase"], pa.binary()), pa.array(found["n"], pa.int64()), pa.array([ids[i] for i in owner], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "print", "phrase", "n", "doc_id"])

    return rows.mapInArrow(run, "lang string, words int, print bigint, phrase binary, n bigint, doc_id bigint")


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``(lang, words, phrase, n, doc_id)``: phrases of up to ``longest`` words that occur ``min_count``
    times in their language, and the smallest id of a document that holds each.

    A row of 0 words gives the number of words of a language. A-Z become lower case; texts
    are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and
    tabs. Occurrences overlap and never cross pieces. A null language is ``und``, a null
    text has no words; repeated rows count as often as they stand; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    filters = []
    for size in range(1, longest + 1):
        frequent = kept(_counted(rows, size, filters[-1] if filters else None).where(F.col("n") >= min_count).select("print"), "frequent")
        filters.append(context.broadcast(_filter(frequent)))
        forget(frequent)
    found = _written_out(rows, filters).groupBy("lang", "words", "print", "phrase").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
    found = found.where((F.col("n") >= min_count) | (F.col("words") == 0))
    found = kept(found.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n", "doc_id"), "phrases")
    for shared in filters:
        shared.unpersist()
    return found


def scored(phrases: DataFrame, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score, doc_id)`` of the phrases of two words and more that stay.

    A phrase is scored by its worst cut into two parts, floor(1000 a n / (l r)), the first of
    equal ones; it goes if a phrase one word longer holds it and occurs at least
    ``contained_percent`` hundredths as often. (Phrases still longer occur no more often, so
    the ones next in length decide.)
    """
    words = F.split("phrase", " ")
    size = F.col("words")
    long = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), "doc_id")
    inner = F.array(F.slice(words, F.lit(1), size - 1), F.slice(words, F.lit(2), size - 1))
    holding = long.where("words > 2").select("lang", F.explode(inner).alias("inner"), "a")
    holding = holding.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("held"))
    staying = long.join(holding, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < contained_percent * F.col("a")))

    cuts = staying.select("lang", "phrase", "words", "a", "doc_id", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left, right = F.slice(words, F.lit(1), F.col("k")), F.slice(words, F.col("k") + 1, size)
    cuts = cuts.select("lang", "phrase", "a", "doc_id", "k", F.array_join(left, " ").alias("left"), F.array_join(right, " ").alias("right"))
    part = phrases.where("words > 0")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    totals = phrases.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = cuts.join(totals, "lang").withColumn("score", _score())
    worst = F.min(F.struct("score", "k", "l", "r", "n", "a", "doc_id")).alias("w")
    cuts = cuts.groupBy("lang", "phrase").agg(worst)
    return cuts.select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score", "w.doc_id")


def _score() -> Column:
    """floor(1000 a n / (l r)), exact: both products fit 38 digits."""
    return F.expr("(CAST(a * 1000 AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    contained_percent: int = CONTAINED_PERCENT,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score, doc_id)``: each language's ``top`` phrases by score,
    then by number of occurrences, then by the bytes of the phrase.

    See :func:`frequent_phrases` and :func:`scored`. An empty table gives an empty table.
    """
    found = scored(frequent_phrases(docs, min_count, longest, id_col, text_col, lang_col), contained_percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id")
