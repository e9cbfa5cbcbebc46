"""Ranked lexical search over impact vectors in buckets of similar length.

A document is a vector of integer impacts, a query one of integer weights, and a score their
inner product. Vectors are ordered by Euclidean length and dealt into buckets. For a query
whose k-th best score so far is t:

* a bucket whose longest vector times the query's length stays below t is skipped, and so are
  all after it (Cauchy-Schwarz);
* inside a bucket, the query's heaviest coordinates are taken until what is left of the query
  times the bucket's length falls below t: only documents that hold one of them can reach t.
  Each gets the bound (product over these coordinates) + (length of the query's rest) *
  (length of the document's rest), and those below t go;
* survivors are scored again, exactly, in 64-bit integers.

About ``BUCKET`` of the longest vectors are searched first, where they lie, to give every query
a t to start from; then all partitions work at once, each raising its own t. Nothing is cut but by these bounds, so the
result is that of scoring every document. Queries are a stated set, worked through in blocks
whose text is bounded; only they, and counts of their terms, are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import forget, kept

TOP = 10
BUCKET = 1 << 14  # vectors
BUCKET_TERMS = 1 << 22  # coordinates in a bucket after which it is closed
BLOCK_CHARS = 1 << 24  # expected characters of the queries that are searched at once
STRETCH = 1 << 20  # bytes of a text taken apart at once
SALTS = 32
SLACK = 1 + 1e-9  # on bounds in floating point

# Digits, letters and everything beyond ASCII stay, A-Z in lower case; the rest are blanks.
_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_counts(data: bytes | None) -> Counter:
    """Terms of UTF-8 ``data`` and how often each occurs, a bounded stretch at a time."""
    found, data, at = Counter(), (data or b"").translate(_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, ids, tfs)``: number of terms, and the terms of ``vocabulary`` with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            totals, sizes, ids, tfs = [], [0], [], []
            for text in batch.column(1):
                counts = term_counts(text.as_py())
                totals.append(counts.total())
                for word in counts.keys() & known.keys():
                    ids.append(known[word])
                    tfs.append(counts[word])
                sizes.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>")


def impacts(n: np.ndarray, sizes: np.ndarray, tfs: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Impact of every coordinate; ``sizes`` are the coordinates of each document."""
    m = np.array([25 + 75 * int(x) * docs // terms for x in n], np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """``(n, sizes, ids, tfs)`` of a batch, the lists laid end to end."""
    n = batch.column("n").to_numpy()
    sizes = batch.column("ids").value_lengths().to_numpy().astype(np.int64)
    return n, sizes, batch.column("ids").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()


def measured(rows: DataFrame, docs: int, terms: int) -> DataFrame:
    """``rows`` that have a coordinate, with the ``length`` of their impact vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, sizes, _, tfs = _flat(batch)
            squares = impacts(n, sizes, tfs, docs, terms).astype(np.float64) ** 2
            length = np.sqrt(np.add.reduceat(squares, np.cumsum(sizes) - sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], [*batch.schema.names, "length"])

    return rows.where(F.size("ids") > 0).mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>, length double")


class Query:
    """Weights of a query's terms, the heaviest first, and the best documents so far."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, top: int, least: int):
        order = np.argsort(-weights, kind="stable")
        self.ids, self.weights, self.top = ids[order], weights[order], top
        left = np.cumsum((self.weights.astype(np.float64) ** 2)[::-1])[::-1]
        self.rest = np.sqrt(np.append(left, 0.0))  # length of the query from each coordinate on
        self.least = max(1, least)
        self.scores, self.docs, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def offer(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        fits = scores >= self.least
        scores, docs, nulls = (np.concatenate([a, b[fits]]) for a, b in ((self.scores, scores), (self.docs, docs), (self.nulls, nulls)))
        best = np.lexsort((docs, nulls, -scores))[: self.top]
        self.scores, self.docs, self.nulls = scores[best], docs[best], nulls[best]
        if len(best) == self.top:
            self.least = max(self.least, int(self.scores[-1]))


class Bucket:
    """Vectors of similar length, by document and by coordinate."""

    def __init__(self, docs, nulls, lengths, sizes, ids, values, width: int):
        self.docs, self.nulls, self.lengths, self.sizes, self.ids, self.values = docs, nulls, lengths, sizes, ids, values
        self.starts, self.longest = np.cumsum(sizes) - sizes, float(lengths.max())
        order = np.argsort(ids, kind="stable")
        self.bounds = np.searchsorted(ids[order], np.arange(width + 1))
        self.posted, self.posted_values = np.repeat(np.arange(len(sizes)), sizes)[order], values[order].astype(np.float64)

    def focus(self, query: Query) -> int:
        """How many of the heaviest coordinates a document must share one of; 0: the bucket is out."""
        return int(np.argmax(query.rest * self.longest * SLACK < query.least))

    def survivors(self, query: Query, focus: int) -> np.ndarray:
        """Documents whose bound reaches the query's least score."""
        parts = [slice(*self.bounds[i : i + 2]) for i in query.ids[:focus]]
        at = np.concatenate([self.posted[p] for p in parts])
        values = np.concatenate([self.posted_values[p] for p in parts])
        weights = np.repeat(query.weights[:focus].astype(np.float64), [p.stop - p.start for p in parts])
        product = np.bincount(at, values * weights, len(self.docs))
        if query.rest[focus] > 0:
            squares = np.bincount(at, values * values, len(self.docs))
            left = np.sqrt(np.maximum(self.lengths**2 * SLACK - squares, 0.0))
            bound = np.where(product > 0, product + query.rest[focus] * left, 0.0)
        else:
            bound = product
        return np.flatnonzero(bound * SLACK >= query.least)

    def search(self, query: Query, dense: np.ndarray) -> None:
        """Offer the query what can be among its best; ``dense`` is all zero before and after."""
        focus = self.focus(query)
        if focus == 0:
            return
        found = self.survivors(query, focus)
        if not len(found):
            return
        dense[query.ids] = query.weights
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[found] - (ends - sizes), sizes)
        scores = np.add.reduceat(dense[self.ids[at]] * self.values[at], ends - sizes)
        dense[query.ids] = 0
        query.offer(scores, self.docs[found], self.nulls[found])


def buckets(batches, docs: int, terms: int, width: int):
    """Cut a stream of vectors, ordered by length, into buckets."""
    held, rows, coordinates = [], 0, 0

    def close():
        n, sizes, ids, tfs = (np.concatenate(x) for x in zip(*map(_flat, held)))
        keys, lengths = (pa.chunked_array([b.column(c) for b in held]) for c in ("doc_id", "length"))
        nulls = keys.is_null().to_numpy()
        return Bucket(keys.fill_null(0).to_numpy(), nulls, lengths.to_numpy(), sizes, ids, impacts(n, sizes, tfs, docs, terms), width)

    for batch in batches:
        for at in range(0, batch.num_rows, BUCKET):
            part = batch.slice(at, BUCKET)
            held.append(part)
            rows += part.num_rows
            coordinates += len(part.column("ids").flatten())
            if rows >= BUCKET or coordinates >= BUCKET_TERMS:
                yield close()
                held, rows, coordinates = [], 0, 0
    if held:
        yield close()


def searched(vectors: DataFrame, shared, least: dict[int, int], docs: int, terms: int, width: int, top: int) -> DataFrame:
    """``(query, doc_id, score)``: the best of each partition of ``vectors`` for every query."""

    def run(batches):
        queries = [Query(ids, weights, top, least.get(i, 1)) for i, (ids, weights) in enumerate(shared.value)]
        dense = np.zeros(width, np.int64)
        for bucket in buckets(batches, docs, terms, width):
            for query in queries:
                bucket.search(query, dense)
        for i, query in enumerate(queries):
            if len(query.scores):
                columns = [pa.array(np.full(len(query.scores), i)), pa.array(query.docs, mask=query.nulls), pa.array(query.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each query with their rank, by salts first, so that no task gets a row per partition."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("place") <= top)
    return salted.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: list, id_col: str, text_col: str, top: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    wanted = [term_counts(row.text.encode() if row.text else None) for row in block]
    vocabulary = {word: i for i, word in enumerate(sorted(set().union(*wanted)))}
    width = len(vocabulary)
    rows = kept(counted(docs, vocabulary, id_col, text_col), "counts")
    sizes = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    number, terms = sizes[0], sizes[1] or 0
    df = np.zeros(width, np.int64)
    holding = rows.select(F.explode("ids").alias("i")).groupBy("i").count().toArrow()  # a row per term of the block
    df[holding["i"].to_numpy()] = holding["count"].to_numpy()
    weight = [math.floor(1000 * math.log((2 * number + 2) / (2 * int(x) + 1))) for x in df]
    queries = []
    for counts in wanted:
        pairs = [(vocabulary[word], n * weight[vocabulary[word]]) for word, n in counts.items()]
        pairs = [p for p in pairs if p[1] > 0]
        queries.append(tuple(np.array([p[j] for p in pairs], np.int64) for j in (0, 1)))
    shared = spark.sparkContext.broadcast(queries)
    vectors = kept(measured(rows, number, terms), "vectors")
    how = (number, terms, width, top)
    cut = F.percentile_approx("length", F.lit(max(0.0, 1 - BUCKET / max(number, 1))), F.lit(10_000))
    longest = vectors.where(F.col("length") >= (vectors.agg(cut).first()[0] or 0.0))
    head = _best(searched(longest, shared, {}, *how), top).where(F.col("rank") == top)
    least = {row.query: row.score for row in head.collect()}  # a row per query of the block
    ordered = vectors.withColumn("spread", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    ordered = ordered.repartitionByRange(F.desc("length"), "spread").drop("spread").sortWithinPartitions(F.desc("length"))
    found = _best(searched(ordered, shared, least, *how), top)
    names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(block)], "query bigint, item_id bigint")
    found = kept(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked")
    forget(rows, vectors)
    return found


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    Terms are runs of letters, digits and all that is not ASCII, A-Z in lower case. A term's
    weight is floor(1000 ln((2N+2)/(2df+1))) and its impact 10^9 tf div (1000 tf + 8 m) with
    m = 25 + 75 n N div L, for N documents with a term, L terms in all, n in the document.
    Equal scores are ordered by id, null ids last. Null and empty texts have no terms, so such
    items have no rows. Repeated documents are documents of their own; rows that repeat item
    id and text are one item, different texts of one item id are ranked separately. Other
    columns are ignored.
    """
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = kept(items.where("length(text) > 0").distinct(), "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    found = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        if block:
            found = found.union(_search_block(docs, block, id_col, text_col, top))
    forget(items)
    return found
