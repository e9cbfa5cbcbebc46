"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A fingerprint is 64 majority votes over the XXH64 values of word shingles. Fingerprints
within ``max_bits`` of each other are linked; a document's component is everything
reachable over links.

Links are found with structured bit masks: bit i gets the vector 1 + i mod (2^(r+1) - 1)
over r + 1 bits, and table v keeps the bits whose vector has an odd product with v.
Vectors of any r differing bits leave some v orthogonal to all of them, so two
fingerprints within r bits agree in that table, always. Each table keeps about 4/7 of the
bits (r = 2), so unrelated fingerprints seldom meet.

Equal fingerprints are one node from the start. A bucket of two is compared directly.
Members of larger buckets are never paired: each is posted under itself and every value
up to r/2 flips away, and two lie within r bits exactly if they share such a value. At
most 65 fingerprints share one (r = 2), whatever the number of copies.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import connected, kept

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CHUNK = 1 << 16  # shingles hashed at once, so that a very long text needs bounded memory


def simhash(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``data``; 0 without words."""
    words = (data or b"").lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    size = min(shingle, len(words))
    votes, number = np.zeros(64, np.int64), 0
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    while part := list(islice(shingles, CHUNK)):
        values = np.fromiter(map(digest, part), "<u8", len(part))
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        number += len(part)
    return int(np.packbits(2 * votes > number, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, bits, text_hash)``: the fingerprint of every row as a signed BIGINT; null text has no words."""

    def run(batches):
        for batch in batches:
            bits = np.array([simhash(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64)), batch.column(2)], ["doc_id", "bits", "text_hash"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id bigint, bits bigint, text_hash bigint")


def masks(max_bits: int) -> list[int]:
    """One mask a table, as signed 64-bit integers."""
    tables = (1 << (max_bits + 1)) - 1
    found = []
    for v in range(1, tables + 1):
        mask = sum(1 << i for i in range(64) if ((1 + i % tables) & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` between distinct ``nodes.bits``: enough links to join every pair within ``max_bits``.

    ``max_bits`` is even, at most 4 (the number of tables doubles with each bit).
    """
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits must be 0, 2 or 4")
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(max_bits))))
    posted = nodes.select("bits", F.explode(tables).alias("p")).select("bits", "p.t", "p.key")
    buckets = kept(
        posted.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b")).where("n > 1"),
        "buckets",
    )
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowd = posted.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("bits").distinct()
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    near = crowd.select("bits", F.col("bits").alias("at"))
    for _ in range(max_bits // 2):
        near = near.select("bits", F.explode(F.array(F.col("at"), *(F.col("at").bitwiseXOR(F.lit(x)) for x in flips))).alias("at"))
    if max_bits > 2:
        near = near.distinct()
    stars = near.select("bits", F.min("bits").over(Window.partitionBy("at")).alias("a")).where("bits <> a").select("a", F.col("bits").alias("b"))
    return pairs.union(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(doc_id, bits, fingerprint, component_id, root, text_hash)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``root`` the smallest
    fingerprint, which no two components share, and ``text_hash`` tells rows of one id apart. Texts that are null or
    without words have fingerprint 0 and are linked like any other; texts of fewer words
    than a shingle have one, all their words. Repeated rows stay repeated; rows with a
    null id are fingerprinted and linked, but never name a component unless nothing else
    can. An empty table gives an empty table; other columns are ignored.
    """
    found = kept(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = kept(found.groupBy("bits").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(links(nodes, max_bits))
    joined = nodes.join(roots, nodes.bits == roots.node, "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "root").select("bits", "component_id", "root")
    return found.join(named, "bits").select(
        "doc_id", "bits", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "root", "text_hash"
    )
