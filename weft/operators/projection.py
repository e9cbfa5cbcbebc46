"""One-mode projection of a hypergraph, listed or factored."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.combiners import Aggregate, Fold, fold_by_key, resolve
from weft.operators.routes import merge_copies
from weft.operators.skew import apart
from weft.operators.superstep import Program, Send, Step, compute
from weft.session import cut, kept

if TYPE_CHECKING:
    from weft.model import Graph, HyperGraph

#: Members of one hyperedge paired within a single join key; larger hyperedges are cut into blocks.
BLOCK = 2000


#: Unordered pairs that a task lists or merges: what bounds its memory, however many pairs there are.
PAIRS_PER_TASK = 500_000


def pair_tasks(spark: SparkSession, pairs: int | None) -> int:
    """Partitions for ``pairs`` rows; their number follows the rows that come out of the pairing,
    which adaptive execution, seeing only the members that go in, underestimates."""
    return max(spark.sparkContext.defaultParallelism, -(-(pairs or 0) // PAIRS_PER_TASK))


def listed_pairs(graph: HyperGraph) -> tuple[int, int]:
    """Members of the largest hyperedge, and unordered pairs of all hyperedges."""
    sizes = graph.inc.groupBy("he_id").agg(F.count("*").alias("n"))
    pairs = F.sum(F.expr("CAST(n AS DECIMAL(38, 0)) * (n + 1) / 2").cast("decimal(38,0)"))
    found = sizes.agg(F.max("n"), pairs).first()
    return found[0] or 0, int(found[1] or 0)


def member_pairs(graph: HyperGraph, values: DataFrame, block: int = BLOCK) -> DataFrame:
    """Unordered pairs ``(a, b, msg, copies)`` with ``a <= b`` of members of each hyperedge.

    ``values(he_id, msg)`` is joined to the members before they are paired.
    A hyperedge with more than ``block`` members is cut into blocks by a hash of the
    member id; every pair of blocks is a join key of its own. So the join never gathers
    more than about ``block**2`` pairs under one key, however large the hyperedge is.
    ``copies`` is the number of ordered incidence pairs each direction stands for. They come
    hash partitioned by ``(a, b)``, in partitions of about :data:`PAIRS_PER_TASK`; so do the
    members before they are paired.
    """
    sizes = graph.inc.groupBy("he_id").agg(F.count("*").alias("n"))
    largest, number = listed_pairs(graph)
    tasks = pair_tasks(graph.inc.sparkSession, number)
    own, other = F.col("hv_id"), F.col("copies")
    if largest <= block:
        # Small hyperedges: one shuffle by hyperedge serves merging, values and pairing.
        rows = graph.inc.select("he_id", "hv_id").repartition(tasks, "he_id")
        members = merge_copies(rows, ["he_id", "hv_id"])
        left = members.join(values, "he_id").select("he_id", own.alias("a"), other.alias("_ca"), "msg")
        right = members.select("he_id", own.alias("b"), other.alias("_cb"))
        pairs = left.join(right, "he_id").where("a <= b")
    else:
        fan = sizes.where(F.col("n") > block).select(
            "he_id", F.ceil(F.col("n") / block).cast("int").alias("_fan")
        )
        blocks = F.coalesce("_fan", F.lit(1)).alias("_fan")
        wide = values.join(fan, "he_id", "left").select("he_id", "msg", blocks)
        # A single join with the members, so that adaptive execution may split it.
        members = cut(
            graph.links()
            .join(apart(wide), "he_id")
            .withColumn("_own", F.pmod(F.xxhash64("hv_id"), F.col("_fan")).cast("int"))
        )
        # Block i meets block j >= i once: i on the left, j on the right.
        later = F.explode(F.sequence("_own", F.col("_fan") - 1)).alias("_hi")
        earlier = F.explode(F.sequence(F.lit(0), "_own")).alias("_lo")
        left = members.select(
            "he_id", own.alias("a"), other.alias("_ca"), "msg", F.col("_own").alias("_lo"), later
        )
        right = members.select(
            "he_id", own.alias("b"), other.alias("_cb"), earlier, F.col("_own").alias("_hi")
        )
        keys = ["he_id", "_lo", "_hi"]
        pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).where("_lo < _hi or a <= b")
    copies = (F.col("_ca") * F.col("_cb")).alias("copies")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "msg", copies)
    return pairs.repartition(tasks, "a", "b")


def _mirror(pairs: DataFrame, *rest: str) -> DataFrame:
    """Both directions of unordered pairs; a self-loop stays one edge."""
    forth = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))
    back = F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    both = F.when(F.col("a") == F.col("b"), F.array(forth)).otherwise(F.array(forth, back))
    return pairs.select(F.explode(both).alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def to_graph(graph: HyperGraph, value: Callable[[Column], Column], combine, block: int = BLOCK, stored: bool = False) -> Graph:
    """See :meth:`weft.model.HyperGraph.to_graph`.

    A pair's value depends on the hyperedge only, so both directions carry the same:
    each unordered pair is combined once and mirrored afterwards. ``stored`` writes the combined
    pairs, so that the far larger shuffles that list them are gone before the edges go anywhere else.
    """
    from weft.model import Graph

    values = graph.he.select(F.col("id").alias("he_id"), value(F.col("attr")).alias("msg"))
    rows = member_pairs(graph, values, block)
    combiner = resolve(combine)
    if isinstance(combiner, Aggregate):
        merged = combiner.expression(F.col("msg"), F.col("copies"))
        edges = rows.groupBy("a", "b").agg(merged.alias("attr"))
    elif isinstance(combiner, Fold):
        edges = fold_by_key(rows, ["a", "b"], "msg", combiner.f, combiner.group_rows)
        edges = edges.withColumnRenamed("msg", "attr")
    else:
        keyed = rows.select(F.struct("a", "b").alias("dst_id"), "msg", "copies")
        edges = combiner.merge(keyed).select("dst_id.a", "dst_id.b", F.col("msg").alias("attr"))
    return Graph(graph.hv.select("id", "attr"), _mirror(kept(edges, "pairs") if stored else edges, "attr"))


class Projection:
    """The one-mode graph with edge weights summed over shared hyperedges, kept factored.

    ``weight(a, b)`` is the sum of ``value(hyperedge attr)`` over the hyperedges that
    hold both. Whatever only sums over neighbours passes through the hyperedges in two
    steps linear in the incidences; the quadratic list of pairs is never made.
    """

    def __init__(self, graph: HyperGraph, value: Callable[[Column], Column]):
        self.graph = graph
        self.valued = graph.map_hyperedges(lambda _, attr: value(attr).cast("double"))

    def out_weights(self) -> DataFrame:
        """``(id, msg)``: total weight of the edges leaving each vertex."""
        links = self.valued.links()
        sizes = links.groupBy("he_id").agg(F.sum("copies").alias("_n"))
        he = self.valued.he.select(F.col("id").alias("he_id"), F.col("attr").alias("_v"))
        each = he.join(sizes, "he_id").select("he_id", (F.col("_v") * F.col("_n")).alias("_w"))
        return (
            links.join(apart(each), "he_id")
            .groupBy(F.col("hv_id").alias("id"))
            .agg(F.sum(F.col("_w") * F.col("copies")).alias("msg"))
        )

    def pagerank(self, max_iters: int, alpha: float = 0.15) -> DataFrame:
        """``(id, rank)`` after ``max_iters`` rounds on the weight-normalized graph."""
        total = self.out_weights().withColumnRenamed("msg", "_total")
        hv = self.valued.hv.select("id").join(total, "id", "left")
        state = F.struct(F.col("_total").alias("total"), F.lit(1.0).alias("rank")).alias("attr")
        start = self.valued.with_tables(hv.select("id", state), self.valued.he)

        def vertex(superstep, _id, attr, msg):
            if superstep == 0:
                return Step(sends=[Send(attr["rank"] / attr["total"], when=attr["total"].isNotNull())])
            rank = alpha + (1.0 - alpha) * msg
            after = F.struct(attr["total"].alias("total"), rank.alias("rank"))
            return Step(after, [Send(rank / attr["total"])])

        def hyperedge(_superstep, _id, attr, msg):
            return Step(sends=[Send(msg * attr)])

        # The vertex program's first run is the start value, hence one more superstep.
        done = compute(
            start, max_iters + 1, F.lit(0.0), Program(vertex, "sum"), Program(hyperedge, "sum")
        )
        return done.hv.select("id", F.col("attr.rank").alias("rank"))
