"""Dense ids without a single-partition sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut

POSITION_BITS = 33  # monotonically_increasing_id() = (partition << 33) + row position


def dense_ids(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` plus ``id`` = 0, 1, 2, ... in the order of the unique columns ``order``."""
    return counted_ids(keys, order)[0]


def _checkpointed(frame: DataFrame, name: str) -> DataFrame:
    return cut(frame)


def counted_ids(
    keys: DataFrame, order: list[str | Column], write: Callable[[DataFrame, str], DataFrame] = _checkpointed
) -> tuple[DataFrame, int]:
    """:func:`dense_ids` and the number of rows.

    Rows are range partitioned and sorted, each takes its position within its
    partition, and that is written once; the row counts of the partitions (one small
    row each) then give every partition its offset. ``write`` may be :func:`weft.session.kept`,
    whose files are smaller than a checkpoint's.
    """
    place = F.monotonically_increasing_id()
    ranked = write(
        keys.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.shiftright(place, POSITION_BITS).cast("int").alias("_part"),
            place.bitwiseAND((1 << POSITION_BITS) - 1).alias("_row"),
        ),
        "ranked",
    )
    counts = ranked.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    offsets, seen = [], 0
    for part, n in counts:  # at most one entry per shuffle partition
        offsets.append((part, seen))
        seen += n
    schema = "_part int, _offset bigint"
    table = F.broadcast(keys.sparkSession.createDataFrame(offsets, schema))
    numbered = ranked.join(table, "_part")
    return numbered.select(*keys.columns, (F.col("_offset") + F.col("_row")).alias("id")), seen
