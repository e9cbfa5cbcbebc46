"""A hypergraph as Parquet, its incidences laid out by part if they are placed."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from weft.model import HyperGraph

TABLES = ("hv", "he", "inc")


def write(graph: HyperGraph, path: str) -> None:
    """``hv``, ``he`` and ``inc``, then ``manifest``: one row, whether incidences are distinct and placed.

    Placed incidences go to a folder per part. They are rebalanced by part first, so that a part
    is few files, and a large one more than one task. ``hv_parts(id, part)`` has the parts of each
    vertex. A null part is written as -1.
    """
    placed = "part" in graph.inc.columns
    graph.hv.write.parquet(f"{path}/hv")
    graph.he.write.parquet(f"{path}/he")
    if placed:
        inc = graph.inc.withColumn("part", F.coalesce(F.col("part").cast("int"), F.lit(-1)))
        inc.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/inc")
        written = graph.inc.sparkSession.read.schema(inc.schema).parquet(f"{path}/inc")
        written.select(F.col("hv_id").alias("id"), "part").distinct().write.parquet(f"{path}/hv_parts")
    else:
        graph.inc.write.parquet(f"{path}/inc")
    manifest = graph.inc.sparkSession.range(1).select(F.lit(graph.distinct).alias("distinct"), F.lit(placed).alias("placed"))
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, path: str, vertices: DataFrame | None = None) -> dict:
    """The tables and ``distinct``; a store without a manifest is neither distinct nor placed.

    For given vertices, the parts they are in (at most as many as there are parts) become a
    filter on the folders of ``inc``.
    """
    known = spark.read.parquet(f"{path}/manifest").first() if _exists(spark, f"{path}/manifest") else None
    found = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    if vertices is not None:
        ids = vertices.select("id").distinct()
        if known and known["placed"]:
            parts = spark.read.parquet(f"{path}/hv_parts").join(ids, "id", "left_semi").select("part").distinct()
            found["inc"] = found["inc"].where(F.col("part").isin([row["part"] for row in parts.collect()]))
        found["inc"] = found["inc"].join(ids.withColumnRenamed("id", "hv_id"), "hv_id", "left_semi").select(*found["inc"].columns)
        found["hv"] = found["hv"].join(ids, "id", "left_semi")
        used = found["inc"].select(F.col("he_id").alias("id")).distinct()
        found["he"] = found["he"].join(used, "id", "left_semi")
    return found | {"distinct": bool(known and known["distinct"])}
