"""Connected components by the largest id."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.model import HyperGraph
from weft.operators.contraction import component_roots
from weft.operators.superstep import Program, Send, Step
from weft.session import cut, forget


def connected_components(
    graph: HyperGraph, max_iters: int | None = None, compat: bool = False
) -> HyperGraph:
    """Label every vertex and hyperedge with the largest id of its component.

    Attributes become ``struct(_1=attr, _2=label)``. By default components are contracted
    (:mod:`weft.operators.contraction`), in few jobs however long their chains are. With a
    number of ``max_iters`` (10 is a common choice) labels flood instead, superstep by
    superstep, and those of longer chains are not final. With ``compat`` a hyperedge's first label is its own id whatever
    it hears (which on a dual, whose hyperedge ids are the small ones, ends the run
    with every node on its own label) and an isolated hyperedge keeps 0; otherwise the
    first label is the larger of both, and an isolated hyperedge keeps its own id.
    """

    if max_iters is None and not compat:
        return _contracted(graph)

    def later(attr, msg):
        return Step(F.greatest(msg, attr), [Send(F.greatest(msg, attr), when=msg > attr)])

    def vertex(superstep, id, attr, msg):
        return Step(id, [Send(id)]) if superstep == 0 else later(attr, msg)

    def hyperedge(superstep, id, attr, msg):
        if superstep > 0:
            return later(attr, msg)
        first = id if compat else F.greatest(msg, id)
        return Step(first, [Send(first)])

    zero = F.lit(0).cast("bigint")
    start = graph.map_vertices(lambda *_: zero).map_hyperedges(
        lambda id, _: zero if compat else id
    )
    done = start.compute(max_iters, zero, Program(vertex, "max"), Program(hyperedge, "max"))
    return graph.attach(done.hv, done.he)


def _contracted(graph: HyperGraph) -> HyperGraph:
    roots = component_roots(graph.links().select(F.col("he_id").alias("a"), F.col("hv_id").alias("b")))
    labels = {}
    for role in ("hv", "he"):
        nodes = getattr(graph, role).select("id").join(roots, "id", "left")
        labels[role] = cut(nodes.select("id", F.coalesce("root", "id").alias("attr")))
    if hasattr(roots, "kept_at"):  # not if there are no links
        forget(roots)
    return graph.attach(labels["hv"], labels["he"])
