"""Links laid out for sending: partitioned and sorted by sender, hot senders spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import SALT, copy_rows, hot_keys, split_rows
from weft.session import shuffle_partitions


class Routes:
    """Rows ``(src_id, dst_id, copies, ...)`` kept for repeated joins with node state.

    A state table that is hash partitioned by ``id`` into ``spark.sql.shuffle.partitions``
    parts joins without moving either side. When some sender has far more links than a
    partition should hold, its links are spread over several pieces and the sender's
    one row is copied to each piece.

    The links are cached; ``stored`` ones are a bucketed table at once, with no shuffle left behind.
    """

    def __init__(self, links: DataFrame, total: int, stored: bool = False):
        from weft.operators.layout import bucketed

        spark = links.sparkSession
        parts = shuffle_partitions(spark)
        self.hot = hot_keys(links, "src_id", total)
        self.stored = stored
        if stored:
            keys = ["src_id"] if self.hot is None else ["src_id", SALT]
            rows = links if self.hot is None else split_rows(links, "src_id", ["dst_id"], self.hot)
            self.table = bucketed(rows.repartition(parts, *keys), keys, parts, "edges")
            return
        if self.hot is None:
            table = links.repartition(parts, "src_id").sortWithinPartitions("src_id")
        else:
            salted = split_rows(links, "src_id", ["dst_id"], self.hot)
            table = salted.repartition(parts, "src_id", SALT).sortWithinPartitions("src_id", SALT)
        self.table = table.persist()

    def join(self, senders: DataFrame) -> DataFrame:
        """``senders`` (one row per ``src_id``) joined with their links."""
        if self.hot is None:
            return senders.hint("merge").join(self.table, "src_id")
        copied = copy_rows(senders, "src_id", self.hot).hint("merge")
        return copied.join(self.table, ["src_id", SALT]).drop(SALT)

    def release(self) -> None:
        from weft.operators.layout import drop_bucketed

        drop_bucketed(self.table) if self.stored else self.table.unpersist()


def merge_copies(links: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel links as one row with their number in ``copies`` (pre-aggregated)."""
    return links.groupBy(*keys).agg(F.count("*").alias("copies"))


def arrange(nodes: DataFrame, parts: int) -> DataFrame:
    """Node rows partitioned and sorted by ``id``, as :class:`Routes` expects, and kept.

    Computed at once, before a loop fixes its plans, so that whatever the node table
    derives from is still planned adaptively, and its partitioning is known afterwards.
    """
    arranged = nodes.repartition(parts, "id").sortWithinPartitions("id").persist()
    arranged.count()
    return arranged
