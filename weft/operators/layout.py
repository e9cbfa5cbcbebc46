"""Tables laid out by Spark bucketing, and what loops keep in them.

A bucketed table remembers how it is partitioned wherever it is read, under adaptive
execution too, and its files lie below the checkpoint folder, so a lost executor costs a
read. Incidences are laid out once per direction (:class:`Layout`) and serve every algorithm
that runs on the same incidences. Node state is a base table and layers of changes
(:class:`NodeState`): a half step writes the nodes that heard something and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.routes import merge_copies
from weft.operators.skew import SALT, copy_rows, hot_keys, split_rows
from weft.session import CLEANUP_CONF, cut, forget, kept, partitions_for, scratch_path, shuffle_partitions, shuffles_deleted

if TYPE_CHECKING:
    from weft.model import HyperGraph
    from weft.operators.near import NearLane

#: Layers of changes that a node table may have before they are merged.
MOST_LAYERS = 4

#: A base of at most so many rows a bucket is written anew instead: one table is read faster than several.
WHOLE_ROWS = 250_000

#: Links a bucket holds beyond the session's number of buckets. Receivers get a message from each bucket that has senders
#: of theirs, so with a bucket for every few links messages hardly combine, and files and tasks are many and small.
BUCKET_LINKS = 500_000

#: Buckets of placed links that are small; beyond that they hold more, since each half step takes tasks and shuffle blocks for all of them.
BUSY = 40

#: Parts of a placement that are dealt to buckets one by one, if there are no more.
MOST_DEALT = 1000

#: Ends of the links by the role that receives.
DIRECTIONS = {"he": ("hv_id", "he_id"), "hv": ("he_id", "hv_id")}

#: How the jobs of a loop are planned. Buckets are of known number and hot keys spread, so
#: nothing is left to adapt; every bucket is one sorted file, so joins need no sort.
LOOP_SETTINGS = {
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",  # links stay with their part, joined by part and sender
    CLEANUP_CONF: "true",  # what a job leaves is a table
}


def loop_session(spark: SparkSession, parts: int) -> SparkSession:
    """A session for a loop's own jobs, with the settings of ``spark`` but for :data:`LOOP_SETTINGS`.

    Nothing is set on ``spark`` itself, so its other queries and other loops are not affected.
    """
    loop = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if loop.conf.isModifiable(key):
            loop.conf.set(key, value)
    for key, value in LOOP_SETTINGS.items():
        loop.conf.set(key, value)
    loop.conf.set("spark.sql.shuffle.partitions", str(parts))
    return loop


def bucketed(frame: DataFrame, keys: list[str], parts: int, name: str, order: list[str] | None = None) -> DataFrame:
    """Write ``frame`` in ``parts`` buckets by ``keys``, each sorted by ``order`` (or the keys), and read it back.

    Rows that already are hash partitioned that way are written where they are, one file a
    bucket; others are shuffled by the caller first.
    """
    spark = frame.sparkSession
    path, table = scratch_path(spark, name), f"weft_{name}_{uuid.uuid4().hex}"
    void = [f.name for f in frame.schema if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
    frame = frame.withColumns({c: F.col(c).cast("int") for c in void}) if void else frame
    with shuffles_deleted(spark):
        frame.write.bucketBy(parts, *keys).sortBy(*(order or keys)).option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.bucketed_as = (table, path)
    return found


def drop_bucketed(frame: DataFrame) -> None:
    """Forget a table of :func:`bucketed` and delete its files."""
    spark, (table, path) = frame.sparkSession, frame.bucketed_as
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slot_keys(spark: SparkSession, parts: int, kind: str = "bigint") -> list[int]:
    """For each of ``parts`` hash partitions the smallest number, of type ``kind``, that Spark deals to it."""
    found: dict[int, int] = {}
    start, step = 0, 32 * parts
    while len(found) < parts:
        rows = spark.range(start, start + step, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast(kind)), F.lit(parts)).alias("part"))
        for part, key in rows.groupBy("part").agg(F.min("id")).collect():  # at most one row per part
            found.setdefault(part, key)
        start += step
    return [found[part] for part in range(parts)]


class Lane:
    """Links of one direction, ``(src_id, dst_id, copies)``, in buckets by sender.

    Senders with far more links than a bucket should hold have them spread over several
    pieces, and their one state row is copied to each.
    """

    def __init__(self, links: DataFrame, total: int, parts: int):
        self.hot = hot_keys(links, "src_id", total, parts)
        self.keys = ["src_id"] if self.hot is None else ["src_id", SALT]
        rows = links if self.hot is None else split_rows(links, "src_id", ["dst_id"], self.hot)
        self.table = bucketed(rows.repartition(parts, *self.keys), self.keys, parts, "links")

    def join(self, senders: DataFrame) -> DataFrame:
        """``senders`` (one row per ``src_id``) with their links; only hot keys move, to their pieces."""
        if self.hot is None:
            return senders.join(self.table, "src_id")
        return copy_rows(senders, "src_id", self.hot).join(self.table, self.keys).drop(SALT)

    def links(self) -> DataFrame:
        return self.table.select("src_id", "dst_id", "copies")

    def release(self) -> None:
        drop_bucketed(self.table)


class PlacedLane(Lane):
    """Links ``(src_id, dst_id, copies, part)`` of one direction that stay where they are placed.

    The links of a part lie in one bucket. A sender's row is shipped once to each part that
    has links of it, which a table of (part, sender) copies says; there its messages are
    combined with those of the part's other senders before they are shuffled to their
    receivers. So a placement decides how many rows travel: a half step ships one row per
    copy of a sender and at most one message per (part, receiver). Parts with far more links
    than a bucket should hold (``hot``) are split by receiver, which adds copies but no messages.
    Parallel links meet in their part and are merged there.
    """

    def __init__(self, links: DataFrame, hot: DataFrame | None, parts: int):
        self.parts, self.hot = parts, hot
        self.keys = ["part"] if self.hot is None else ["part", SALT]
        rows = links if self.hot is None else split_rows(links, "part", ["dst_id"], self.hot)
        rows = merge_copies(rows.repartition(parts, *self.keys), [*self.keys, "src_id", "dst_id"])
        self.table = bucketed(rows, self.keys, parts, "links", [*self.keys, "src_id"])
        copies = self.table.select("src_id", *self.keys).distinct()
        self.copies = bucketed(copies.repartition(parts, "src_id"), ["src_id"], parts, "copies")

    def join(self, senders: DataFrame) -> DataFrame:
        """``senders`` (one row per ``src_id``), shipped to the parts they have links in, with those links."""
        shipped = senders.join(self.copies, "src_id").repartition(self.parts, *self.keys)
        return shipped.join(self.table, [*self.keys, "src_id"]).drop(SALT)

    def release(self) -> None:
        super().release()
        drop_bucketed(self.copies)


@dataclass(frozen=True)
class Layout:
    """Incidences in both directions, by the role that receives, and the number of buckets.

    Incidences with a column ``part`` (of ``assign_parts``) are laid out by part.
    """

    lanes: dict[str, Lane]
    parts: int

    @staticmethod
    def of(graph: HyperGraph) -> Layout:
        """Merge parallel incidences and write both directions; the caller releases them."""
        if "part" in graph.inc.columns:
            return Layout._placed(graph)
        spark = graph.inc.sparkSession
        links = graph.links().persist()
        try:
            total = links.count()
            parts = max(partitions_for(spark, total, BUCKET_LINKS), shuffle_partitions(spark))
            lanes = {}
            for receiver, (a, b) in DIRECTIONS.items():
                directed = links.select(F.col(a).alias("src_id"), F.col(b).alias("dst_id"), "copies")
                lanes[receiver] = Lane(directed, total, parts)
        finally:
            links.unpersist()
        return Layout(lanes, parts)

    @staticmethod
    def _placed(graph: HyperGraph) -> Layout:
        """Placed incidences are written once as they are and shuffled once per direction, by part only."""
        spark = graph.inc.sparkSession
        links = kept(graph.inc.select("he_id", "hv_id", F.coalesce(F.col("part").cast("int"), F.lit(-1)).alias("part")), "placed")
        total = links.count()
        parts = min(partitions_for(spark, total), max(BUSY, partitions_for(spark, total, BUCKET_LINKS)))
        parts = max(parts, shuffle_partitions(spark))
        # few parts are few keys, which would meet in few buckets: each gets a number that is dealt to a bucket of its own
        found = sorted(r.part for r in links.select("part").distinct().limit(min(parts, MOST_DEALT) + 1).collect())
        rows = links
        if 0 < len(found) <= min(parts, MOST_DEALT):
            numbers = dict(zip(found, slot_keys(spark, parts, "int")))
            named = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
            rows = links.withColumn("part", named[F.col("part")])
        hot = hot_keys(rows, "part", total, parts)
        lanes = {}
        for receiver, (a, b) in DIRECTIONS.items():
            directed = rows.select(F.col(a).alias("src_id"), F.col(b).alias("dst_id"), "part")
            lanes[receiver] = PlacedLane(directed, hot, parts)
        forget(links)
        return Layout(lanes, parts)

    def links(self) -> DataFrame:
        """``(he_id, hv_id, copies)``, bucketed by hyperedge unless some are split or incidences are placed."""
        found = self.lanes["hv"].links()
        if isinstance(self.lanes["hv"], PlacedLane):  # a pair may be in several parts
            found = found.groupBy("src_id", "dst_id").agg(F.sum("copies").alias("copies"))
        return found.select(F.col("src_id").alias("he_id"), F.col("dst_id").alias("hv_id"), "copies")

    def dual(self) -> Layout:
        return Layout({"he": self.lanes["hv"], "hv": self.lanes["he"]}, self.parts)

    def release(self) -> None:
        for lane in self.lanes.values():
            lane.release()


class NodeState:
    """``(id, attr)`` of one role: a base table and layers of later values, the newest last."""

    def __init__(self, nodes: DataFrame, parts: int, loop: SparkSession):
        self.parts, self.spark = parts, nodes.sparkSession
        first = bucketed(nodes.select("id", "attr").repartition(parts, "id"), ["id"], parts, "nodes")
        self.number = first.count()
        self.whole = self.number <= WHOLE_ROWS * parts
        self.base = loop.table(first.bucketed_as[0])
        self.base.bucketed_as = first.bucketed_as
        self.written = [self.base]
        self.table: DataFrame | None = self.base  # whose columns the base is, if any
        self.layers: list[list] = []  # [table, rows of it that are still the newest of their id]

    def replace(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Let the base be what ``f`` makes of its rows; nothing is written."""
        rows = f(self.base)
        self.base, self.table = rows.select("id", "attr"), None
        return rows

    def rewrite(self, rows: DataFrame) -> DataFrame:
        """Write ``rows(id, attr, ...)`` of all nodes as the base, before any layer."""
        table = bucketed(rows.repartition(self.parts, "id"), ["id"], self.parts, "nodes")
        stale, self.base, self.table, self.written = self.written, table.select("id", "attr"), table, [table]
        for old in stale:
            drop_bucketed(old)
        return table

    def current(self, messages: DataFrame | None = None) -> DataFrame:
        """``(id, attr, _layer)``, and ``dst_id`` and ``msg`` if ``messages(dst_id, msg)`` are given.

        Then there are only nodes that have one, unless the table is written whole. ``_layer``
        is the number of the layer that the attribute comes from, -1 for the base.
        """
        rows, attr, layer = self.base, F.col("attr"), F.lit(-1)
        if messages is not None:
            rows = rows.join(messages, F.col("id") == F.col("dst_id"), "left" if self.whole else "inner")
        for i, (table, _) in enumerate(self.layers):
            values = table.select(F.col("id").alias(f"_id{i}"), F.col("attr").alias(f"_attr{i}"))
            rows = rows.join(values, F.col("id") == F.col(f"_id{i}"), "left")
            attr = F.when(F.col(f"_id{i}").isNotNull(), F.col(f"_attr{i}")).otherwise(attr)
            layer = F.when(F.col(f"_id{i}").isNotNull(), F.lit(i)).otherwise(layer)
        return rows.select("id", attr.alias("attr"), *([] if messages is None else ["dst_id", "msg"]), layer.alias("_layer"))

    def beside(self, messages: DataFrame, lane: NearLane) -> DataFrame:
        """:meth:`current` for ``messages(slot, dst_id, msg)`` of a near lane: the nodes go to their messages, these stay."""
        rows = self.current().withColumn("_own", lane.slot("id")).repartition(lane.parts, "_own")
        found = messages.withColumnRenamed(lane.key, "_at")
        on = (F.col("_own") == F.col("_at")) & (F.col("id") == F.col("dst_id"))
        rows = rows.join(found, on, "left" if self.whole else "inner")
        return rows.select("id", "attr", "dst_id", "msg", "_layer")

    def counters(self) -> list:
        """Aggregates over :meth:`current` that :meth:`push` takes: how many rows each layer gave."""
        return [F.count_if(F.col("_layer") == i).alias(f"layer{i}") for i in range(len(self.layers))]

    def push(self, rows: DataFrame) -> DataFrame:
        """Write ``rows(id, attr, ...)``: the newest layer, or all nodes if the table is written whole."""
        table = bucketed(rows, ["id"], self.parts, "nodes")
        self.written.append(table)
        return table

    def pushed(self, table: DataFrame, rows: int, counts: dict[str, int]) -> None:
        """Count layers down by what the new one replaces, drop the empty ones, merge if there are many."""
        if self.whole:
            stale, self.base, self.table = self.written[:-1], table.select("id", "attr"), table
            self.written = [table]
            for old in stale:
                drop_bucketed(old)
            return
        for i, layer in enumerate(self.layers):
            layer[1] -= counts[f"layer{i}"]
        gone = [layer for layer in self.layers if layer[1] == 0]
        self.layers = [layer for layer in self.layers if layer[1] > 0]
        for old, _ in gone:
            self._drop(old)
        if rows:
            self.layers.append([table, rows])
        if len(self.layers) > MOST_LAYERS:
            self._merge()

    def _merge(self) -> None:
        """One layer, or a new base if that would be half as large.

        The newest layer stays as it is: what its nodes send is still to be delivered.
        """
        *old, newest = self.layers
        live = sum(n for _, n in old)
        if 2 * live >= self.number:
            self.layers = old
            base = bucketed(self.current().select("id", "attr"), ["id"], self.parts, "nodes")
            stale, self.base, self.table, self.layers = self.written[0], base, base, [newest]
            self.written[0] = base
            drop_bucketed(stale)
        else:
            every = [table.select("id", F.struct("attr").alias("_new"), F.lit(i).alias("_at")) for i, (table, _) in enumerate(old)]
            union = every[0]
            for more in every[1:]:
                union = union.unionByName(more)
            union = union.groupBy("id").agg(F.max_by("_new", "_at").alias("_new")).select("id", "_new.attr")
            table = bucketed(union.repartition(self.parts, "id"), ["id"], self.parts, "nodes")
            # what the newest layer replaced in these is no longer told apart: the merged layer counts all its rows
            self.written.append(table)
            self.layers = [[table, table.count()], newest]
        for table, _ in old:
            self._drop(table)

    def _drop(self, table: DataFrame) -> None:
        self.written = [t for t in self.written if t is not table]
        drop_bucketed(table)

    def finish(self) -> DataFrame:
        """``(id, attr)`` of all nodes, in a checkpoint of its own, for the session they came from."""
        if self.layers or self.table is None:
            self.table = bucketed(self.current().select("id", "attr"), ["id"], self.parts, "nodes")
            self.written.append(self.table)
        return cut(self.spark.table(self.table.bucketed_as[0]).select("id", "attr"))

    def release(self) -> None:
        for table in self.written:
            drop_bucketed(table)
