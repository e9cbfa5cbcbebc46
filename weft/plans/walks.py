"""Random walk with restart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import divide
from weft.model import HyperGraph
from weft.operators import structure
from weft.operators.combiners import fields, total
from weft.operators.superstep import Program, Send, Step


def random_walk(
    graph: HyperGraph,
    max_iters: int,
    starting_ids: list[int] | DataFrame,
    restart: float,
    epsilon: float,
) -> HyperGraph:
    """Walk from ``starting_ids`` (ints, or a frame with a column ``id``).

    A vertex passes its share on only while the share exceeds ``epsilon``, and the
    restart mass itself is not passed on, so activity dies out and vertices keep the
    value of the last superstep that reached them. Hyperedges (``struct(card,
    weight)``) divide what they hear by their cardinality; their own value stays 0.
    Attributes become ``struct(_1=attr, _2=value)``.
    """
    if isinstance(starting_ids, DataFrame):
        marks = starting_ids.select("id").distinct().withColumn("_start", F.lit(True))
        hv = graph.hv.select("id").join(marks, "id", "left")
        begins = F.coalesce("_start", F.lit(False))
    else:
        hv = graph.hv.select("id")
        begins = F.col("id").isin([int(i) for i in starting_ids])
    hv = hv.withColumn("_begins", begins)
    one_or_zero = F.when(F.col("_begins"), F.lit(1.0)).otherwise(F.lit(0.0))
    hv = hv.select("id", F.struct(F.col("_begins").alias("start"), one_or_zero.alias("value")).alias("attr"))

    def vertex(superstep, id, attr, msg):
        if superstep == 0:
            return Step(sends=[Send(attr["value"])])
        walked = (1.0 - restart) * msg["value"]
        value = F.when(attr["start"], restart + walked).otherwise(walked)
        share = divide(walked, msg["weight"])
        state = F.struct(attr["start"].alias("start"), value.alias("value"))
        return Step(state, [Send(share, when=share > epsilon)])

    def hyperedge(superstep, id, attr, msg):
        weight = attr["weight"].cast("bigint")
        return Step(sends=[Send(F.struct(weight.alias("weight"), divide(msg, attr["card"]).alias("value")))])

    start = graph.with_tables(hv, graph.he.select("id", F.struct("attr.card", "attr.weight").alias("attr")))
    unused = F.struct(F.lit(1).cast("bigint").alias("weight"), F.lit(0.0).alias("value"))
    to_vertex = fields(weight=total(), value=total())
    done = start.compute(max_iters, unused, Program(vertex, "sum"), Program(hyperedge, to_vertex))
    values = done.hv.select("id", F.col("attr.value").alias("attr"))
    hyperedges = graph.augment(F.lit(0.0), F.lit(0.0)).he
    return graph.with_tables(structure.attach(graph.hv, values), hyperedges)
