"""Exact numbers of distinct co-members: pairs of small hyperedges, bitmaps of large ones.

Listing the pairs of a hyperedge is quadratic in its members. Here only hyperedges of at
most ``heavy`` members are paired. Members of larger ones get dense ids, and the members of
each such hyperedge are bits of Spark's bitmaps (buckets of ``BUCKET`` bits). Vertices in the
same large hyperedges have the same co-members there, so these are united once for each
different set of large hyperedges, not for each vertex. A pair of a small hyperedge then
counts only if its bit is not set already.

Both list what hyperedges hold, which is quadratic in their members even where two of them
hardly share any. Where vertices are in few hyperedges, the sizes of these are added up
instead, and what is counted twice is taken off: bitmaps of what two hyperedges share, made
from the vertices that are in both. The cheaper of the two ways is taken, by counts.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ids import counted_ids
from weft.operators import projection
from weft.operators.projection import BLOCK, _mirror, member_pairs
from weft.operators.skew import apart
from weft.session import cut, discard, forget, kept
from weft.sources.groups import identical

if TYPE_CHECKING:
    from weft.model import HyperGraph

#: Members above which a hyperedge is a bitmap: its pairs take more bytes than a few bitmaps.
HEAVY = 1000

BUCKET = 32768  # bits of one of Spark's bitmaps, fixed by bitmap_construct_agg

WORD = 64  # bits of a word of what two hyperedges share

#: Pairs that cost as much as one bitmap (4 KB), and vertices below which bitmaps are few at any rate.
PAIRS_PER_BITMAP, FEW = 256, 100_000


def bit(bitmap: Column, place: Column) -> Column:
    """Bit ``place`` (0 .. BUCKET - 1) of a bitmap, as INT."""
    at = place.cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, at % 8).bitwiseAND(1)


def co_members(graph: HyperGraph, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """``(id, neighbours)``: exact number of distinct co-members, self included; 0 if isolated.

    ``heavy`` decides how a hyperedge is counted, never the result.
    """
    links = graph.links().select("he_id", "hv_id")
    known = graph.he.select(F.col("id").alias("he_id"))
    sizes = links.groupBy("he_id").agg(F.count("*").alias("_n")).join(known, "he_id", "left_semi")
    links = cut(links.join(apart(sizes.select("he_id", (F.col("_n") > heavy).alias("_heavy"))), "he_id"))
    kinds = {r[0] for r in links.select("_heavy").distinct().collect()}  # at most two rows

    linked = links.where("hv_id IS NOT NULL")
    most = _listed(linked)
    if _meetings(linked) <= most:
        found = _by_meetings(linked.select("he_id", "hv_id"), most, block)
        if found is not None:
            return _all_vertices(graph, found)

    pairs = around = places = None
    if False in kinds:
        light = type(graph)(graph.hv, graph.he, links.where("NOT _heavy").select("he_id", "hv_id"))
        one = graph.he.select(F.col("id").alias("he_id"), F.lit(1).alias("msg"))
        pairs = _mirror(member_pairs(light, one, block).select("a", "b").distinct())
    if True in kinds:
        around, places = _united(links.where("_heavy").select("he_id", "hv_id"))
    if pairs is None and around is None:
        return graph.hv.select("id", F.lit(0).cast("bigint").alias("neighbours"))

    counts = []
    if around is not None:
        union = around.groupBy("set").agg(F.sum(F.bitmap_count("bits")).alias("_n"))
        counts.append(places.select("id", "set").join(apart(union), "set").select("id", "_n"))
        if pairs is not None:
            pairs = _beyond(pairs, around, places)
    if pairs is not None:
        counts.append(pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n")))
    found = counts[0] if len(counts) == 1 else counts[0].union(counts[1]).groupBy("id").agg(F.sum("_n").alias("_n"))
    return _all_vertices(graph, found)


def _all_vertices(graph: HyperGraph, found: DataFrame) -> DataFrame:
    number = F.coalesce("_n", F.lit(0)).cast("bigint").alias("neighbours")
    return graph.hv.select("id").join(found, "id", "left").select("id", number)


def _pairs(n: str, with_self: int) -> Column:
    return F.expr(f"CAST({n} AS DECIMAL(38, 0)) * ({n} + {2 * with_self - 1}) / 2").cast("decimal(38,0)")


def _listed(links: DataFrame) -> int:
    """What listing takes: pairs of the hyperedges that are not heavy, and a bitmap for each vertex
    of the others unless there are few."""
    sizes = links.where("NOT _heavy").groupBy("he_id").agg(F.count("*").alias("n"))
    pairs = int(sizes.agg(F.sum(_pairs("n", 1))).first()[0] or 0)
    wide = links.where("_heavy").select("hv_id").distinct().count()
    return pairs + (PAIRS_PER_BITMAP * wide if wide > FEW else 0)


def _meetings(links: DataFrame) -> int:
    """How often two hyperedges meet in a vertex."""
    degrees = links.groupBy("hv_id").agg(F.count("*").alias("n"))
    return int(degrees.agg(F.sum(_pairs("n", 0))).first()[0] or 0)


def _by_meetings(links: DataFrame, most: int, block: int) -> DataFrame | None:
    """``(id, _n)`` from the sizes of a vertex's hyperedges and what these share.

    Vertices of the same hyperedges are one class and have consecutive numbers; a class is
    cut into chunks, the bits of a 64-bit word. Of the hyperedges of a class, in the order of their ids,
    each counts its members but those that it shares with an earlier one: a union of the chunks
    that the two have in common. Two hyperedges that meet in one chunk only share nothing but that, so only
    the others are kept. Returns ``None`` if joining these would take more than ``most`` rows.
    """
    from weft.model import HyperGraph

    sizes = links.groupBy("he_id").agg(F.count("*").alias("_size"))
    rows = links.select(F.col("hv_id").alias("record"), F.col("he_id").alias("label"), F.col("he_id").alias("member"))
    inside, sets, prints = identical(rows)
    order = ["label", "set", "record"]
    numbered, _ = counted_ids(prints.select(*order), order)
    places = numbered.join(apart(numbered.groupBy("set").agg(F.min("id").alias("cls"))), "set")
    places = kept(places.select("record", "set", "cls", F.col("id").alias("place")), "places")
    classes = places.where("place = cls").select("set", "cls")
    edges = kept(inside.withColumnRenamed("member", "he_id").join(apart(classes), "set").select("cls", "he_id"), "classes")
    forget(inside, sets, prints)

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % WORD).cast("int"))
    chunks = places.groupBy("cls", F.expr(f"place div {WORD}").alias("word")).agg(F.min("place").alias("chunk"), F.bit_or(bit).alias("bits"))
    chunks = kept(chunks, "chunks")
    members = kept(edges.join(apart(chunks.select("cls", "chunk")), "cls").select(F.col("chunk").alias("he_id"), F.col("he_id").alias("hv_id")), "members")
    none = F.lit(None).cast("int").alias("attr")
    ends = HyperGraph(edges.select(F.col("he_id").alias("id"), none), chunks.select(F.col("chunk").alias("id"), none), members, True)
    what = chunks.select(F.col("chunk").alias("he_id"), F.struct("chunk", "cls", "word", "bits").alias("msg"))
    together = Window.partitionBy("a", "b")
    met = projection.member_pairs(ends, what, block).where("a < b").select("a", "b", "msg.*")
    met = kept(met.withColumn("_n", F.count("*").over(together)).where("_n > 1"), "meetings")

    first = met.where("chunk = cls")
    joined = first.agg(F.sum(F.col("_n").cast("decimal(38,0)"))).first()[0] or 0
    if joined > most:
        forget(places, edges, chunks, members, met)
        return None
    asked = first.select("a", "b", F.col("cls").alias("_asks"))
    tasks = projection.pair_tasks(links.sparkSession, int(joined))
    shared = asked.repartition(tasks, "a", "b").join(met.repartition(tasks, "a", "b"), ["a", "b"]).where("chunk <> _asks")
    again = (
        shared.groupBy(F.col("_asks").alias("cls"), "b", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy("cls")
        .agg(F.sum(F.bit_count("bits")).alias("_again"))
    )
    total = edges.join(apart(sizes), "he_id").groupBy("cls").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_k"))
    own = chunks.where("chunk = cls").select("cls", F.bit_count("bits").alias("_own"))
    number = F.col("_sum") - (F.col("_k") - 1) * F.col("_own") - F.coalesce("_again", F.lit(0))
    counted = total.join(own, "cls").join(again, "cls", "left").select("cls", number.alias("_n"))
    return places.select(F.col("record").alias("id"), "cls").join(apart(counted), "cls").select("id", "_n")


def _united(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Co-members through ``links`` of large hyperedges.

    Returns ``(set, bucket, bits)`` for each different set of hyperedges that a vertex is in,
    and ``(id, set, bucket, place)``: a vertex, its set and its own bit. Vertices are numbered
    by their first hyperedge, so that the members of one lie in few buckets.
    """
    pairs = links.select(F.col("hv_id").alias("record"), F.col("he_id").alias("label"), F.col("he_id").alias("member"))
    inside, sets, prints = identical(pairs)
    order = ["label", "set", "record"]
    numbered, _ = counted_ids(prints.select(*order), order)
    at = [F.expr(f"id div {BUCKET}").alias("bucket"), (F.col("id") % BUCKET).alias("place")]
    places = cut(numbered.select(F.col("record").alias("hv_id"), "set", *at))
    bits = (
        links.join(apart(places.drop("set")), "hv_id")
        .groupBy("he_id", "bucket")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )
    around = (
        inside.withColumnRenamed("member", "he_id")
        .join(apart(bits), "he_id")
        .groupBy("set", "bucket")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    around = cut(around)
    forget(inside, sets, prints)
    return around, places.withColumnRenamed("hv_id", "id")


def _beyond(pairs: DataFrame, around: DataFrame, places: DataFrame) -> DataFrame:
    """The ``pairs(src, dst)`` that no bitmap holds: both ends in large hyperedges and the bit set."""
    own = places.select(F.col("id").alias("src"), "set")
    other = places.select(F.col("id").alias("dst"), "bucket", "place")
    marked = pairs.join(apart(own), "src", "left").join(apart(other), "dst", "left")
    held = marked.join(apart(around), ["set", "bucket"], "left")
    return held.where(F.col("bits").isNull() | (bit(F.col("bits"), F.col("place")) == 0)).select("src", "dst")
