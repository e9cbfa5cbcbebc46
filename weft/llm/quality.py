"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

Words fall into ``BUCKETS`` hash buckets. Every bucket has a fixed sparse ternary index
vector; a bucket's word vector is the sum of the index vectors of its neighbours over the
whole corpus, scaled to unit length, plus its own index vector. The table has a fixed
size (8 MB), so it can be summed in each task, added up over two shuffles in slices, and
broadcast. A document is the mean of its words' vectors.

Only the network sees labels: it is fitted on at most ``MAX_LABELLED`` labelled documents
(those with the smallest hash of their id), with a fifth of them held back to choose the
temperature of the probabilities.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept

BUCKETS = 1 << 14
DIM = 128
NONZERO = 4
SLICE = 64  # buckets in one row of the sums
MAX_LABELLED = 20_000
THRESHOLD = 0.7
CACHE_WORDS = 500_000
CHUNK = 1 << 16  # words pooled at once
MARKS = 64  # the last buckets: written in capitals; the very last: repeats the word before

_WORDS = re.compile(r"\w+|[^\w\s]+").findall


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


class Buckets(dict):
    """Bucket of a word, remembered. Words of several capitals share a few buckets of their own."""

    def __missing__(self, word: str) -> int:
        low = word.lower()
        value = zlib.crc32(low.encode("utf-8", "replace"))
        if len(word) > 1 and word.isupper():
            bucket = BUCKETS - MARKS + value % (MARKS - 1)
        else:
            bucket = value % (BUCKETS - MARKS)
        self[word] = bucket
        return bucket

    def of(self, text: str | None) -> np.ndarray:
        """Buckets of a text's words in order; a word that repeats the one before it counts as a repetition."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = _WORDS(text or "")
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(found) > 1:
            found[1:][found[1:] == found[:-1]] = BUCKETS - 1
        return found


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors, float32 (BUCKETS, DIM), from every text of ``docs``."""

    def count(batches):
        places, signs = index_vectors()
        buckets = Buckets()
        sums = np.zeros(BUCKETS * DIM)

        def add(words):
            left, right = words[:-1], words[1:]
            real = (left >= 0) & (right >= 0)
            left, right = left[real], right[real]
            for here, there in ((left, right), (right, left)):
                for s in range(NONZERO):
                    sums.__iadd__(np.bincount(here * DIM + places[there, s], weights=signs[there, s], minlength=BUCKETS * DIM))

        apart, parts, size = np.array([-1]), [], 0
        for batch in batches:
            for text in batch.column(0):
                words = buckets.of(text.as_py())
                parts += [words, apart]
                size += len(words)
                if size > 1 << 20:
                    add(np.concatenate(parts))
                    parts, size = [], 0
        if parts:
            add(np.concatenate(parts))
        whole = sums.astype(np.int64).reshape(-1, SLICE * DIM)
        used = np.flatnonzero(whole.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([zlib.compress(whole[i].tobytes(), 1) for i in used], pa.binary())], ["slice", "sums"]
        )

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SLICE * DIM, np.int64)
        for x in frame["sums"]:
            out += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"slice": frame["slice"][:1], "sums": [zlib.compress(out.tobytes(), 1)]})

    schema = "slice bigint, sums binary"
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, schema)
    group = F.shiftright(F.spark_partition_id(), 8).alias("part")  # 256 tasks' sums at a time
    sums = parts.withColumn("part", group).groupBy("slice", "part").applyInPandas(lambda f: total(f), schema)
    rows = sums.groupBy("slice").applyInPandas(lambda f: total(f), schema).collect()  # BUCKETS / SLICE rows
    table = np.zeros((BUCKETS // SLICE, SLICE * DIM))
    for row in rows:
        table[row.slice] = np.frombuffer(zlib.decompress(bytes(row.sums)), np.int64)
    table = table.reshape(BUCKETS, DIM)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors()
    np.add.at(table, (np.arange(BUCKETS)[:, None], places), signs / np.sqrt(NONZERO))
    return table.astype(np.float32)


def pooled(table: np.ndarray, buckets: Buckets, text: str | None) -> np.ndarray:
    """Mean vector of a text's words; zeros if it has none."""
    words = buckets.of(text)
    out = np.zeros(DIM)
    for at in range(0, len(words), CHUNK):
        out += table[words[at : at + CHUNK]].sum(axis=0, dtype=np.float64)
    return out / max(1, len(words))


@dataclass
class Network:
    """Two layers over standardised pooled vectors; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the logistic loss; a fifth of the rows is held back for the temperature.

    With no rows, or one class only, the answer is the (smoothed) share of label 1.
    """
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIM), np.ones(DIM))
    net = Network(mean, scale, rng.normal(0, DIM**-0.5, (DIM, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return net
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - mean) / scale
    state, step = [(0.0, 0.0)] * 4, 0
    for epoch in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 256):
            rows = used[at : at + 256]
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - h * h)
            grads = [z[rows].T @ back + decay * net.w1, back.sum(0), h.T @ error + decay * net.w2, error.sum()]
            step += 1
            pace, values = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)), [net.w1, net.b1, net.w2, net.b2]
            for i, g in enumerate(grads):
                m, v = 0.9 * state[i][0] + 0.1 * g, 0.999 * state[i][1] + 0.001 * g * g
                state[i] = (m, v)
                values[i] = values[i] - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.w1, net.b1, net.w2, net.b2 = values
    if len(held):
        raw, target = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, raw / t) - target * raw / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, those with the smallest hash; null or disagreeing labels are left out."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_label_id"))
    clear = rows.agg(F.min(label_col).cast("int").alias("_label"), F.max(label_col).cast("int").alias("_top")).where("_label = _top")
    return clear.orderBy(F.xxhash64("_label_id"), "_label_id").limit(limit).select("_label_id", "_label")


@dataclass
class QualityModel:
    table: np.ndarray
    network: Network

    def scorer(self, spark) -> callable:
        """A Column function: text -> probability of label 1."""
        sent = spark.sparkContext.broadcast((self.table, vars(self.network)))

        @F.pandas_udf("double")
        def score(texts):
            table, network = sent.value[0], Network(**sent.value[1])
            buckets = _buckets()
            return pd.Series(network.probability(np.array([pooled(table, buckets, t) for t in texts]).reshape(-1, DIM)))

        return score


_BUCKETS: list[Buckets] = []


def _buckets() -> Buckets:
    """One per Python worker, kept over batches."""
    if not _BUCKETS:
        _BUCKETS.append(Buckets())
    return _BUCKETS[0]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED
) -> QualityModel:
    """Word vectors from all of ``docs``; the network from its rows that ``labels`` marks 0 or 1.

    Leave out of ``labels`` what must not be learned from. Repeated labels of an id count
    once if they agree and not at all if they differ; so do null labels.
    """
    table = word_vectors(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches):
        buckets = Buckets()
        for batch in batches:
            vectors = [pooled(sent.value, buckets, t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["y", "x"])

    sample = F.broadcast(labelled_sample(labels, id_col, label_col, max_labelled))  # bounded by max_labelled
    rows = docs.select(F.col(id_col).cast("bigint").alias("_label_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(sample, "_label_id").dropDuplicates(["_label_id"])
    found = rows.select("_label", "_text").mapInArrow(pool, "y int, x binary").collect()
    found.sort(key=lambda r: (bytes(r.x), r.y))  # tasks end in any order
    x = np.array([np.frombuffer(r.x, np.float32) for r in found], float).reshape(-1, DIM)
    return QualityModel(table, fit(x, np.array([r.y for r in found], float)))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row; null and empty texts pool to zeros and are scored too."""
    score = model.scorer(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were."""
    keep: Column = model.scorer(docs.sparkSession)(F.col(text_col).cast("string")) >= threshold
    return docs.where(keep)
