"""Links that lie with their receivers, for messages that are wide: sketches above all.

A message for each link, combined before the shuffle, is right for numbers. A sketch takes a
KB or more, and where a sender has many links and a receiver few, messages hardly combine: one
sketch travels for each link. Here links are dealt by receiver to few parts and sorted by it. A
sender's row travels once to each part, is found there by a hash join that keeps the order of
the links, and the messages of a receiver are combined one after the other as they pass. No
joined row is ever shuffled, sorted or written.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.layout import bucketed, drop_bucketed, slot_keys

SLOT = "_slot"

#: Links of a part beyond the number of tasks that run at once; every part takes most senders' rows once more.
PART_LINKS = 4_000_000

#: Bytes of senders' rows that the hash table of a part may hold.
PART_BYTES = 512 << 20

#: Bytes of senders' rows under way at once, beyond those of as many parts as tasks run at once.
WAVE_BYTES = 4 << 30

#: How a job over :class:`NearLane` is planned: messages of a receiver arrive together, so nothing is hashed or sorted.
SETTINGS = {"spark.sql.execution.useObjectHashAggregateExec": "false"}


def parts_for(spark: SparkSession, links: int, senders: int, size: int) -> int:
    """Parts for ``links`` of ``senders`` whose rows take ``size`` bytes together.

    As many as tasks run at once, more from :data:`PART_LINKS` on, and so many that the senders that
    a part is expected to meet stay within :data:`PART_BYTES`, their links being spread evenly.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-links // PART_LINKS))
    if size > PART_BYTES:
        most = max(1.0, -senders * math.log1p(-PART_BYTES / size))
        parts = max(parts, math.ceil(links / most))
    return parts


def rows_shipped(parts: int, links: int, senders: int) -> float:
    """Rows that travel when each sender goes to every part that it is expected to have links in."""
    return parts * senders * -math.expm1(-links / (parts * max(senders, 1)))


class NearLane:
    """Links ``(src_id, dst_id, ...)`` in parts by receiver, and ``(src_id, part)`` of what senders must reach.

    A part goes by its slot, a number that Spark deals to it, so no two parts meet in a bucket.
    """

    key = SLOT

    def __init__(self, links: DataFrame, parts: int, sender_parts: int):
        self.parts, self.slots = parts, slot_keys(links.sparkSession, parts)
        rows = links.withColumn(SLOT, self.slot("dst_id"))
        self.table = bucketed(rows.repartition(parts, SLOT), [SLOT], parts, "links", [SLOT, "dst_id"])
        copies = self.table.select("src_id", SLOT).distinct()
        self.copies = bucketed(copies.repartition(sender_parts, "src_id"), ["src_id"], sender_parts, "copies")

    def slot(self, key: str):
        """The slot of the receiver ``key``."""
        number = F.pmod(F.hash(F.col(key)), F.lit(self.parts)) + 1
        return F.element_at(F.array(*map(F.lit, self.slots)), number).cast("bigint")

    def join(self, senders: DataFrame, slots: list[int] | None = None, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """``senders`` (one row per ``src_id``) with their links in ``slots`` (all), in the order of slot and receiver.

        ``tables`` are links and copies as the session of the job sees them.
        """
        table, copies = tables or (self.table, self.copies)
        if slots is not None:
            table, copies = (x.where(F.col(SLOT).isin(slots)) for x in (table, copies))
        shipped = senders.join(copies, "src_id").repartition(self.parts, SLOT)
        return table.join(shipped.hint("shuffle_hash"), [SLOT, "src_id"])

    def waves(self, links: int, senders: int, size: int) -> list[list[int] | None]:
        """Slots to be served at a time, so that what travels stays within :data:`WAVE_BYTES`."""
        each = rows_shipped(self.parts, links, senders) / self.parts * size / max(senders, 1)
        number = max(self.table.sparkSession.sparkContext.defaultParallelism, int(WAVE_BYTES / max(each, 1)))
        if number >= self.parts:
            return [None]
        return [self.slots[i : i + number] for i in range(0, self.parts, number)]

    def release(self) -> None:
        drop_bucketed(self.table)
        drop_bucketed(self.copies)
