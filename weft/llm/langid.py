"""Language identification with bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the letter n-grams that are its own: those at least
``MIN_SHARE`` as frequent in it as in the language that uses them most. The filters are
stored bit-sliced: slot i is a bit mask over languages, so the AND of an n-gram's few
slots names all languages whose filter contains it. A text's n-grams vote by per-language
popcounts, corrected for the false positives that each filter's fill predicts.

N-grams (one to three lower-case letters, with a mark where a word begins or ends) are
packed into 64-bit numbers and counted over all training texts, in each task and then by
Spark; only the filter, whose size is fixed, reaches the driver. Texts are handled as
arrays of code points, a bounded stretch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import kept, worker_store

SLOTS = 1 << 20  # a power of two
HASHES = 4
MIN_SHARE = 0.25
MIN_COUNT = 2
WORD_BITS = 62  # languages in one word of a slot
STRETCH = 1 << 20  # characters handled at once
UNKNOWN = "und"

_POINT = 21  # bits of a code point
_NONE = np.int64((1 << _POINT) - 1)  # fills the places of shorter n-grams


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    store = worker_store()
    if "letters" not in store:
        store["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return store["letters"]


def stretches(texts: list[str | None]):
    """``(stream, owners, sizes)`` of about ``STRETCH`` characters: code points, 0 for all that
    is no letter, and whose text each run of ``sizes`` belongs to. A text longer than that is
    cut at a blank (without one, at the limit), so its words stay whole.
    """
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text) or not text:
            end = min(len(text), at + STRETCH)
            if end < len(text):
                end = max(text.rfind(" ", at, end), at) if text.rfind(" ", at, end) > at else end
            parts.append(text[at:end])
            owners.append(i)
            size += end - at
            at = end
            if size >= STRETCH:
                yield _stream(parts), np.array(owners), np.array([len(p) + 2 for p in parts])
                parts, owners, size = [], [], 0
            if not text:
                break
    if parts:
        yield _stream(parts), np.array(owners), np.array([len(p) + 2 for p in parts])


def _stream(parts: list[str]) -> np.ndarray:
    """Each part between two marks."""
    points = np.frombuffer(("\0" + "\0\0".join(parts) + "\0").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where(letters()[points], points, 0)


def packed_grams(stream: np.ndarray):
    """``(packed, real)`` for each size: the n-gram that ends, or for three letters is centred, at each place."""
    before, after = np.concatenate([[0], stream[:-1]]), np.concatenate([stream[1:], [0]])
    letter = stream > 0
    yield (stream << 2 * _POINT) | (_NONE << _POINT) | _NONE, letter
    yield (before << 2 * _POINT) | (stream << _POINT) | _NONE, letter | (before > 0)
    yield (before << 2 * _POINT) | (stream << _POINT) | after, letter


def slots_of(packed: np.ndarray, slots: int) -> list[np.ndarray]:
    """``HASHES`` slots of each n-gram, by double hashing of the halves of a mixed product."""
    x = packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    first, second = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(i) * second) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


def counted(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a stream and their numbers."""
    points = np.flatnonzero(np.bincount(stream))  # the alphabet in use, 0 first if present
    small = np.searchsorted(points, stream)
    names, numbers = [], []
    for size, (packed, real) in zip((1, 2, 3), packed_grams(stream)):
        if len(points) ** size > 1 << 24:  # a large alphabet: sort instead of counting in place
            found, n = np.unique(packed[real], return_counts=True)
        else:
            before, after = np.concatenate([[0], small[:-1]]), np.concatenate([small[1:], [0]])
            place = {1: small, 2: before * len(points) + small, 3: (before * len(points) + small) * len(points) + after}[size]
            n = np.bincount(place[real], minlength=1)
            used = np.flatnonzero(n)
            where = np.empty(len(n), np.int64)
            where[place[real]] = packed[real]
            found, n = where[used], n[used]
        names.append(found)
        numbers.append(n)
    return np.concatenate(names), np.concatenate(numbers)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows with a text and a language."""

    def count(batches):
        sums: dict[str, list] = {}

        def settle(lang):
            names, numbers = (np.concatenate(x) for x in zip(*sums[lang]))
            found, back = np.unique(names, return_inverse=True)
            sums[lang] = [(found, np.bincount(back, weights=numbers).astype(np.int64))]

        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for stream, _, _ in stretches(texts):
                    sums.setdefault(lang, []).append(counted(stream))
                    if len(sums[lang]) > 8:
                        settle(lang)
        for lang in sums:
            settle(lang)
            names, numbers = sums[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names), pa.array(numbers)], ["lang", "gram", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (slots, words) masks over languages
    false_rate: np.ndarray  # of each language's filter

    def masks(self, packed: np.ndarray) -> np.ndarray:
        """(n-grams, words): the languages whose filter contains each."""
        first, *others = slots_of(packed, len(self.table))
        found = self.table[first]
        for slots in others:
            found &= self.table[slots]
        return found

    def votes(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: number of n-grams, then of those in each language's filter."""
        out = np.zeros((len(texts), len(self.langs) + 1))
        for stream, owners, sizes in stretches(texts):
            starts = np.cumsum(sizes) - sizes
            for packed, real in packed_grams(stream):
                found = self.masks(packed[real])
                ends = np.concatenate([[0], np.cumsum(real)])  # of the real ones before each place
                bounds = ends[np.append(starts, len(stream))]
                np.add.at(out[:, 0], owners, np.diff(bounds))
                for i in range(len(self.langs)):
                    bits = ((found[:, i // WORD_BITS] >> (i % WORD_BITS)) & 1).astype(np.int8)
                    sums = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
                    np.add.at(out[:, i + 1], owners, np.diff(sums[bounds]))
        return out

    def vote(self, total: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score for rows of n-gram totals and per-language hits."""
        real = np.maximum(hits - total[:, None] * self.false_rate, 0) / (1 - self.false_rate)
        best = real.argmax(axis=1)  # ties: first language in order
        return best, real[np.arange(len(best)), best] / np.maximum(real.sum(axis=1), 1e-9)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS) -> LanguageModel:
    """Filters from every row of ``docs`` with a text and a language (null either: not used)."""
    counts = kept(gram_counts(docs, text_col, lang_col), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    langs = sorted(totals)
    if not langs:
        return LanguageModel([], np.zeros((slots, 1), np.int64), np.zeros(0))
    names = F.broadcast(docs.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(langs)], "lang string, i int, total double"))
    rates = counts.where(F.col("n") >= MIN_COUNT).join(names, "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("rate"))
    most = F.max("rate").over(Window.partitionBy("gram"))  # at most a row per language
    own = rates.withColumn("most", most).where(F.col("rate") >= MIN_SHARE * F.col("most"))

    def place(batches):
        for batch in batches:
            at = np.concatenate(slots_of(batch.column(0).to_numpy(), slots))
            lang = np.tile(batch.column(1).to_numpy(), HASHES)
            columns = [pa.array(at), pa.array((lang // WORD_BITS).astype(np.int32)), pa.array(np.int64(1) << (lang % WORD_BITS).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "word", "bit"])

    places = own.select("gram", "i").mapInArrow(place, "slot bigint, word int, bit bigint")
    sliced = places.groupBy("slot", "word").agg(F.expr("bit_or(bit)").alias("mask"))
    table = np.zeros((slots, -(-len(langs) // WORD_BITS)), np.int64)
    for batch in sliced.toArrow().to_batches():  # at most ``slots`` rows a word
        table[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    number = np.arange(len(langs))
    fill = np.array([((table[:, i // WORD_BITS] >> (i % WORD_BITS)) & 1).mean() for i in number])
    return LanguageModel(langs, table, np.minimum(fill**HASHES, 0.999))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row; ``und`` with score 0 for null or letterless texts.

    ``score`` is the winner's share of the corrected votes; no votes at all (or no learned
    language) is ``und`` for a model without languages and otherwise the first language
    with score 0. An empty table gives an empty table; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.false_rate))

    def run(batches):
        for batch in batches:
            model = LanguageModel(*sent.value)
            langs = model.langs
            if langs:
                sums = model.votes(batch.column(1).to_pylist())
                best, score = model.vote(sums[:, 0], sums[:, 1:])
                names = [langs[b] if n else UNKNOWN for b, n in zip(best, sums[:, 0])]
                score = np.where(sums[:, 0] > 0, np.clip(score, 0, 1), 0.0)
            else:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
