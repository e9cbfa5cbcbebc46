"""Label propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.model import HyperGraph
from weft.operators.superstep import Program, Send, Step


def label_propagation(graph: HyperGraph, max_iters: int) -> HyperGraph:
    """Every node takes the most frequent label it hears, ties going to the largest.

    Vertices start with their id. Attributes become ``struct(_1=attr, _2=label)``.
    """

    def vertex(superstep, id, attr, msg):
        label = id if superstep == 0 else msg
        return Step(label, [Send(label)])

    def hyperedge(superstep, id, attr, msg):
        return Step(msg, [Send(msg)])

    zero = F.lit(0).cast("bigint")
    start = graph.map_vertices(lambda *_: zero).map_hyperedges(lambda *_: zero)
    done = start.compute(max_iters, zero, Program(vertex, "mode"), Program(hyperedge, "mode"))
    return graph.attach(done.hv, done.he)
