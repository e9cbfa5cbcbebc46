"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its ``prefix`` nearest pivots in order, and posted in the
inverted files of these pivots with its rank there. A query reads the files of its own
nearest pivots, adds up the footrule distance of the two orders (a pivot that one of them
lacks counts as rank ``prefix``), and the vectors with the smallest distance are
reranked by their exact inner product.

Equal vectors are one row of the index, with the smallest of their ids, and one pivot at
most: copies take no places from others. Ids are put in again when a block's best are known.

Vectors are dealt by hash into blocks of about ``BLOCK`` rows, each with its own inverted
files, so that no pivot's file can grow with the data or with how common a vector is.
Queries are dealt into groups of about ``QUERIES``; a task holds one block and one group.
The share ``rerank`` of every block is reranked, at every size of the data, with all
whose distance equals that of its last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import kept

PIVOTS = 128
PREFIX = 32
RERANK = 0.3
LEAST = 500  # reranked in any case, so that a small block is searched whole
BLOCK = 16_384
QUERIES = 4_096
K = 20


def usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` as doubles, without null, empty, zero vectors or such with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = frame.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def pivots_of(vectors: DataFrame, number: int = PIVOTS) -> np.ndarray:
    """The ``number`` vectors with the smallest hash of their components, scaled to unit length; ``vectors`` are distinct."""
    rows = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(number).collect()
    found = np.array([r.v for r in rows], float)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def distinct(vectors: DataFrame, most: int) -> DataFrame:
    """``(vec_id, v, ids)``: each vector once, with its smallest ``most`` ids in order; ``vec_id`` is the first."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # cut off before the shuffle too
    few = vectors.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "v", "ids")


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(rows, prefix) pivot numbers, nearest first; ties: smaller number."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


class InvertedFiles:
    """Postings of a block: for each pivot the rows near it, with their ranks."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.rank = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int16)
        self.ends = np.searchsorted(flat[by], np.arange(pivots + 1))
        ranks = np.arange(self.prefix)
        #: what a pivot saves against the distance without it, by rank in query and row
        self.saved = ((self.prefix - ranks)[:, None] + (self.prefix - ranks) - np.abs(ranks[:, None] - ranks)).astype(np.int16)

    def similarity(self, order: np.ndarray) -> np.ndarray:
        """For each row, prefix * (prefix + 1) minus the footrule distance to a query's order."""
        sums = np.zeros(self.rows, np.int32)
        for rank, pivot in enumerate(order):
            part = slice(self.ends[pivot], self.ends[pivot + 1])
            sums[self.row[part]] += self.saved[rank][self.rank[part]]  # a row is in a file once
        return sums


def search(
    base: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    rerank: float = RERANK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every query, nearest first.

    ``score`` is the inner product in double precision; ties go to the smaller id. A row
    is never its query's own neighbour (same id). All vectors must have one length. Vectors
    that are null, zero, or hold null or non-finite components take no part, as query or as
    candidate; repeated rows of an id count once, the greatest components winning. With fewer than
    ``k`` candidates all are returned; without queries or candidates nothing is.
    """
    vectors = usable(base, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v"))
    vectors = kept(distinct(vectors, k + 1), "vectors")  # one of the ids may be the query's own
    asked = kept(usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v")), "asked")
    centres = pivots_of(vectors, pivots)
    prefix = min(prefix, len(centres))
    blocks = max(1, -(-vectors.count() // BLOCK))
    groups = max(1, -(-asked.count() // QUERIES))
    sent = base.sparkSession.sparkContext.broadcast(centres)

    def block(key, rows, asked):
        out = []
        if len(rows) and len(asked):
            ids, v = rows["vec_id"].to_numpy(), np.array(rows["v"].tolist(), float)
            own = np.argsort(ids, kind="stable")
            ids, v, every = ids[own], v[own], [rows["ids"].iloc[i] for i in own]
            alone = np.array([len(x) == 1 for x in every])
            files = InvertedFiles(orders(v, sent.value, prefix), len(sent.value))
            q = np.array(asked["v"].tolist(), float)
            count = min(len(ids), max(LEAST, int(np.ceil(rerank * len(ids)))))
            for query, vector, order in zip(asked["vec_id"].to_numpy(), q, orders(q, sent.value, prefix)):
                near = files.similarity(order)
                found = np.flatnonzero(near >= np.partition(near, -count)[-count]) if count < len(ids) else np.arange(len(ids))
                found = found[(ids[found] != query) | ~alone[found]]
                score = v[found] @ vector
                if len(found) > k:
                    least = np.partition(score, -k)[-k]
                    good = score >= least  # all ties of the last place, so that the smaller ids can win
                    found, score = found[good], score[good]
                names = [every[i] for i in found]
                score = np.repeat(score, [len(x) for x in names])
                names = np.concatenate(names) if names else np.zeros(0, np.int64)
                names, score = names[names != query], score[names != query]
                best = np.lexsort((names, -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": names[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    left = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    found = pairs.applyInPandas(block, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
