"""Number of vertices that share a hyperedge with a vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.model import HyperGraph
from weft.operators.comembers import HEAVY, co_members
from weft.operators.layout import loop_session
from weft.operators.near import SETTINGS, SLOT, NearLane, parts_for, rows_shipped
from weft.operators.projection import PAIRS_PER_TASK, pair_tasks
from weft.operators.skew import apart, hot_keys
from weft.session import forget, kept, shuffle_partitions

# Sketch size (log2 of its registers) and the relative error of one standard deviation.
SKETCH_BITS = 12
STANDARD_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def registers(ids: Column) -> tuple[Column, Column]:
    """Register (0..4095) and rank (1..53) of an id: of the 64 first bits of the MD5 of its
    decimal text, the first 12 and the place of the first 1 among the other 52."""
    digest = F.md5(ids.cast("string").cast("binary"))
    register = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    rest = F.conv(F.substring(digest, 4, 13), 16, 10).cast("bigint")
    return register, F.when(rest == 0, F.lit(53)).otherwise(53 - F.length(F.bin(rest)))


def neighbour_registers(graph: HyperGraph) -> DataFrame:
    """``(id, register, rank)``: the sketch of each vertex's co-members, itself included, as rows.

    A hyperedge's register is the largest rank of its members there, a vertex's the largest of
    its hyperedges; registers that stay empty have no row. Both are plain maxima over rows of
    fixed size: they combine before each shuffle, small neighbourhoods take few rows, and no
    sketch is ever held in one value. Sketches of any vertices unite by ``max`` per register.
    Tasks follow the number of rows that members and registers make (about ``PAIRS_PER_TASK``
    each); the members of a hyperedge that makes more are spread over pieces.
    """
    inc = graph.links().select("he_id", "hv_id")
    rows = F.expr(f"n * least(n, {1 << SKETCH_BITS})")
    sizes = inc.groupBy("he_id").agg(F.count("*").alias("n")).select("he_id", rows.alias("_rows"))
    number, largest = sizes.agg(F.sum(F.col("_rows").cast("decimal(38,0)")), F.max("_rows")).first()
    tasks = pair_tasks(inc.sparkSession, int(number or 0))
    register, rank = registers(F.col("hv_id"))
    inside = inc.select("he_id", register.alias("register"), rank.alias("rank"))
    inside = inside.groupBy("he_id", "register").agg(F.max("rank").alias("rank"))
    keys = ["he_id"]
    if (largest or 0) > PAIRS_PER_TASK:
        fan = sizes.where(F.col("_rows") > PAIRS_PER_TASK)
        fan = fan.select("he_id", F.ceil(F.col("_rows") / PAIRS_PER_TASK).cast("int").alias("_fan"))
        blocks = F.coalesce("_fan", F.lit(1))
        inc = inc.join(apart(fan), "he_id", "left").select("he_id", "hv_id", F.pmod(F.xxhash64("hv_id"), blocks).cast("int").alias("_own"))
        inside = inside.join(apart(fan), "he_id", "left").select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_own")).drop("_fan")
        keys = ["he_id", "_own"]
    around = inc.repartition(tasks, *keys).join(inside.repartition(tasks, *keys), keys)
    around = around.select(F.col("hv_id").alias("id"), "register", "rank").repartition(tasks, "id", "register")
    return around.groupBy("id", "register").agg(F.max("rank").alias("rank"))


def estimates(sketches: DataFrame) -> DataFrame:
    """``(id, estimate)`` (DOUBLE) from the register rows of each id.

    The harmonic mean over all registers, empty ones being 0; while it is below 2.5 times
    their number and some are empty, the count follows from how many are.
    """
    size = 1 << SKETCH_BITS
    found = sketches.groupBy("id").agg(F.count("*").alias("_full"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_sum"))
    raw = F.lit(0.7213 / (1 + 1.079 / size) * size * size) / (F.col("_sum") + (size - F.col("_full")))
    few = size * F.log(F.lit(float(size)) / (size - F.col("_full")))
    return found.select("id", F.when((raw <= 2.5 * size) & (F.col("_full") < size), few).otherwise(raw).alias("estimate"))


def _estimated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("_s")).alias("_n")).select(F.col("hv_id").alias("id"), "_n")


def _united_sketches(inc: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(id, _n)``: the estimate of the united ``sketches(he_id, _s)`` of each vertex's hyperedges.

    A sketch travels once to each of few parts of the vertices (:mod:`weft.operators.near`), not once
    per incidence. Vertices with far more hyperedges than others, and all where that
    ships no fewer rows, unite what their incidences bring, combined before the shuffle.
    """
    spark = inc.sparkSession
    links = inc.where("he_id IS NOT NULL AND hv_id IS NOT NULL")
    sketches = kept(sketches.where("he_id IS NOT NULL"), "sketches")
    senders, size = sketches.agg(F.count("*"), F.coalesce(F.sum(F.length("_s")), F.lit(0))).first()
    total, receivers = links.agg(F.count("*"), F.approx_count_distinct("hv_id")).first()
    parts = parts_for(spark, total, senders, size)
    if 2 * rows_shipped(parts, total, senders) > total or senders > receivers:
        return _estimated(inc.join(apart(sketches), "he_id"), "hv_id")

    hot = hot_keys(links, "hv_id", total)
    found = []
    if hot is not None:
        marked = links.join(hot, "hv_id", "left")
        busy, links = marked.where("_fan IS NOT NULL").drop("_fan"), marked.where("_fan IS NULL").drop("_fan")
        found.append(_estimated(busy.join(apart(sketches), "he_id"), "hv_id"))
    loop = loop_session(spark, parts)
    for key, value in SETTINGS.items():
        loop.conf.set(key, value)
    lane = NearLane(links.select(F.col("he_id").alias("src_id"), F.col("hv_id").alias("dst_id")), parts, shuffle_partitions(spark))
    mine = loop.read.schema(sketches.schema).parquet(sketches.kept_at).withColumnRenamed("he_id", "src_id")
    near = loop.table(lane.table.bucketed_as[0]), loop.table(lane.copies.bucketed_as[0])
    for slots in lane.waves(total, senders, size):
        rows = lane.join(mine, slots, near).withColumnRenamed("dst_id", "hv_id")
        found.append(spark.read.parquet(kept(_estimated(rows, SLOT, "hv_id"), "estimates").kept_at))
    lane.release()
    if hot is None:
        forget(sketches)
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    return united


def neighbour_counts(graph: HyperGraph, exact: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Distinct co-members per vertex, the vertex itself included; 0 if isolated.

    By default a sketch estimate, ``(id, estimate, low, high)`` with an interval of two
    standard errors: each hyperedge sketches its members, each vertex unites the
    sketches of its hyperedges. Linear in the incidences; see :func:`_united_sketches`.
    ``exact=True`` returns ``(id, neighbours)``: hyperedges of up to ``heavy`` members list
    their pairs, larger ones are bitmaps.
    """
    if exact:
        return co_members(graph, heavy)
    inc = graph.inc.select("he_id", "hv_id")
    sketches = inc.groupBy("he_id").agg(F.hll_sketch_agg("hv_id", F.lit(SKETCH_BITS)).alias("_s"))
    counts = _united_sketches(inc, sketches)
    estimate = F.coalesce("_n", F.lit(0)).cast("bigint")
    margin = estimate * (2 * STANDARD_ERROR)
    return (
        graph.hv.select("id")
        .join(counts, "id", "left")
        .select(
            "id",
            estimate.alias("estimate"),
            F.floor(estimate - margin).alias("low"),
            F.ceil(estimate + margin).alias("high"),
        )
    )
