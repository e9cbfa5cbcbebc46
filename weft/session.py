"""Session helpers: the shared checkpoint folder, cutting lineage, fixed plans for loops."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A key is "hot" only above this many rows, whatever the size of the data.
HOT_ROWS_CONF = "spark.weft.hotRows"
HOT_ROWS_DEFAULT = 1_000_000

#: Whether Spark deletes the shuffles of a command when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Links in a partition of a loop, up to MANY partitions and beyond them.
LINKS_PER_PARTITION, MANY, LINKS_BEYOND = 100_000, 10_000, 5_000_000

#: Loops change settings of their session, so one runs at a time.
_LOOPS = threading.RLock()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, registered with the context.

    A folder of our own is made only where the setting is absent *and* Spark runs in
    local mode (tests): on a cluster a machine-local folder would not survive the loss
    of its machine, so there a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="weft-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for an intermediate table."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Shuffles of the commands enclosed are deleted as each ends.

    What a command wrote is all that is read later. Else its shuffle files stay until the driver happens to collect garbage.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before) if before is not None else spark.conf.unset(CLEANUP_CONF)


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the checkpoint folder and continue from the written rows."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def kept(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage as a checkpoint does, but columnar and compressed, and with a size
    that the planner knows. A checkpoint keeps the size estimated for its plan, a product over
    its joins: where a loop joins what it wrote before, the digits of that number multiply with
    every round, until planning takes longer than the job. Every executor can read the files,
    so a lost one costs nothing.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    with shuffles_deleted(spark):
        frame.write.parquet(path)
    written = spark.read.schema(frame.schema).parquet(path)
    written.kept_at = path
    return written


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables that :func:`kept` wrote, once nothing reads them any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(frame: DataFrame | None) -> None:
    """Delete the files behind a frame returned by :func:`cut`, once nothing reads it."""
    if frame is None:
        return
    plan = frame._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def partitions_for(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """Partitions for a loop over ``rows`` links, ``each`` (:data:`LINKS_PER_PARTITION`) in one, from the data alone.

    Adaptive execution is off in loops, so nothing splits a partition later; the session's
    setting is no bound.
    """
    return max(1, min(MANY, -(-rows // (each or LINKS_PER_PARTITION))), -(-rows // LINKS_BEYOND))


@contextmanager
def fixed_plans(spark: SparkSession, partitions: int):
    """Plan the enclosed jobs statically, with ``partitions`` shuffle partitions.

    Loops lay their tables out once (hash partitions of a known number, hot keys
    already spread) and want every round to keep that layout. Under adaptive execution
    a checkpointed frame forgets how it is partitioned, and each round would shuffle
    the node state again. Loops of several threads wait for one another, so that each
    finds and restores the session's own settings; other queries of the session that run
    meanwhile are planned statically too.
    """
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        CLEANUP_CONF: "true",
    }
    with _LOOPS:
        before = {key: spark.conf.get(key) for key in settings}
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
