"""The two data types: a hypergraph of three tables and a one-mode graph of two."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import placement, projection, store, structure, superstep
from weft.operators.layout import Layout

Predicate = Callable[[Column, Column], Column]


def _nodes(table: DataFrame) -> DataFrame:
    if "attr" not in table.columns:
        table = table.withColumn("attr", F.lit(None).cast("int"))
    return table


@dataclass(frozen=True)
class HyperGraph:
    """``hv(id, attr)`` vertices, ``he(id, attr)`` hyperedges, ``inc(he_id, hv_id)`` incidences.

    Ids of both roles share one space. ``inc`` is a multiset unless ``distinct`` says
    that no row repeats. Extra columns (such as ``orig_id``) ride along in ``hv``/``he``.
    Every operator returns a new hypergraph.
    """

    hv: DataFrame
    he: DataFrame
    inc: DataFrame
    distinct: bool = False
    layout: Layout | None = field(default=None, compare=False, repr=False)

    # -- construction -----------------------------------------------------------------

    @staticmethod
    def from_tables(
        inc: DataFrame,
        hv: DataFrame,
        he: DataFrame,
        partition: tuple[str, int, int] | None = None,
        validate: bool = False,
        distinct: bool = False,
        shift: int | None = None,
    ) -> HyperGraph:
        """Build from ``inc(he_id, hv_id)``, ``hv(id[, attr])`` and ``he(id[, attr])``.

        Hyperedge ids are shifted by ``max(vertex id) - min(hyperedge id) + 1`` so that
        both roles share one id space; ``he.orig_id`` keeps the id given.
        ``partition=(strategy, parts, threshold)`` also places the incidences.
        ``validate=True`` raises on incidences naming unknown ids and on repeated ids.
        A caller that knows the shift passes it, which saves two small jobs.
        """
        hv, he = _nodes(hv), _nodes(he)
        if validate:
            structure.validate(inc, hv, he)
        if shift is None:
            shift = structure.id_shift(hv, he)
        graph = HyperGraph(
            hv.select("id", "attr"),
            he.select((F.col("id") + shift).alias("id"), "attr", F.col("id").alias("orig_id")),
            inc.select((F.col("he_id") + shift).alias("he_id"), "hv_id"),
            distinct,
        )
        return graph.partition_by(*partition) if partition else graph

    def with_tables(self, hv: DataFrame, he: DataFrame) -> HyperGraph:
        return HyperGraph(hv, he, self.inc, self.distinct, self.layout)

    def prepare(self) -> HyperGraph:
        """This hypergraph with its incidences laid out for supersteps, once for all algorithms.

        Both directions are written below the checkpoint folder as tables bucketed by sender,
        parallel incidences merged. Whatever keeps the incidences (attribute maps,
        :meth:`dual`, every algorithm's result) keeps the layout. :meth:`release` deletes it.
        """
        return self if self.layout else replace(self, layout=Layout.of(self))

    def release(self) -> None:
        """Delete the layout of :meth:`prepare`; no graph that shares it can be used for supersteps afterwards."""
        if self.layout:
            self.layout.release()

    # -- sinks ------------------------------------------------------------------------

    def write_parquet(self, path: str) -> None:
        """Write the three tables and, last, a manifest of what is known of them.

        Placed incidences (``inc.part``) are partitioned by part, with the parts of every
        vertex beside them, so that a read for some vertices opens only their parts.
        """
        store.write(self, path)

    @staticmethod
    def read_parquet(spark: SparkSession, path: str, vertices: DataFrame | None = None) -> HyperGraph:
        """A hypergraph of :meth:`write_parquet`, ``distinct`` and placement included.

        With ``vertices(id)`` only these, their incidences and the hyperedges that have them.
        """
        return HyperGraph(**store.read(spark, path, vertices))

    # -- views ------------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        """``(id, role, attr)`` of all nodes; ``attr`` is ``struct(vertex, hyperedge)``, the
        field of the other role being null."""
        return structure.nodes(self)

    def links(self) -> DataFrame:
        """Incidences with parallel ones merged: ``(he_id, hv_id, copies)``."""
        return structure.links(self)

    def triplets(self) -> DataFrame:
        """``(hv_id, hv_attr, he_id, he_attr)`` per incidence."""
        return structure.triplets(self)

    def summary(self) -> DataFrame:
        """One row: numbers of vertices, hyperedges and incidences."""
        return structure.summary(self)

    # -- attributes -------------------------------------------------------------------

    def map_vertices(self, f: Callable[[Column, Column], Column]) -> HyperGraph:
        """Replace vertex attributes by ``f(id, attr)``."""
        return self.with_tables(structure.map_attr(self.hv, f), self.he)

    def map_hyperedges(self, f: Callable[[Column, Column], Column]) -> HyperGraph:
        """Replace hyperedge attributes by ``f(id, attr)``."""
        return self.with_tables(self.hv, structure.map_attr(self.he, f))

    def augment(self, vertex: Column, hyperedge: Column) -> HyperGraph:
        """Attributes become ``struct(_1=attr, _2=constant)``."""
        return self.with_tables(
            structure.augment(self.hv, vertex), structure.augment(self.he, hyperedge)
        )

    def strip(self) -> HyperGraph:
        """Inverse of :meth:`augment`."""
        return self.map_vertices(lambda _, attr: attr["_1"]).map_hyperedges(
            lambda _, attr: attr["_1"]
        )

    def attach(self, hv: DataFrame, he: DataFrame) -> HyperGraph:
        """Attributes become ``struct(_1=attr, _2=value)`` with values joined by id.

        Nodes without a row in ``hv(id, attr)`` / ``he(id, attr)`` get a null value.
        """
        return self.with_tables(structure.attach(self.hv, hv), structure.attach(self.he, he))

    def update_vertices(self, values: DataFrame, f: Predicate) -> HyperGraph:
        """``f(attr, value)`` on the vertices that have a row in ``values(id, value)``; others keep theirs."""
        return self.with_tables(structure.update(self.hv, values, f), self.he)

    def update_hyperedges(self, values: DataFrame, f: Predicate) -> HyperGraph:
        return self.with_tables(self.hv, structure.update(self.he, values, f))

    # -- structure --------------------------------------------------------------------

    def degrees(self) -> HyperGraph:
        """Attributes become the number of incidences (INT, 0 for isolated nodes)."""
        return structure.degrees(self)

    def sub_hypergraph(
        self,
        vertex: Predicate | None = None,
        hyperedge: Predicate | None = None,
        retain_isolated: bool = False,
    ) -> HyperGraph:
        """Keep the nodes whose predicate ``(id, attr) -> Column`` holds and the incidences between them.

        Nodes left without incidences go too, unless ``retain_isolated``.
        """
        return structure.sub_hypergraph(self, vertex, hyperedge, retain_isolated)

    def dual(self) -> HyperGraph:
        """Vertices become hyperedges and the reverse; ids stay."""
        part = [c for c in self.inc.columns if c == "part"]
        inc = self.inc.select(F.col("hv_id").alias("he_id"), F.col("he_id").alias("hv_id"), *part)
        return HyperGraph(self.he, self.hv, inc, self.distinct, self.layout and self.layout.dual())

    def to_graph(self, value: Callable[[Column], Column], combine="sum", block: int = projection.BLOCK) -> Graph:
        """One-mode projection: an edge for every ordered pair of members of a hyperedge.

        ``value`` maps a hyperedge attribute to an edge value; ``combine`` (``"sum"``,
        ``"max"``, ``"min"``, a combiner, or a binary function) merges the values of
        a pair that shares several hyperedges. Self-loops and both directions are
        included. See :class:`~weft.operators.projection.Projection` for the factored
        form that never lists the pairs.
        """
        return projection.to_graph(self, value, combine, block)

    def assign_parts(self, strategy: str, parts: int, threshold: int = placement.DEGREE_CUTOFF) -> HyperGraph:
        """Add ``inc.part``, taking vertices as sources and hyperedges as destinations.

        Supersteps then keep the incidences of a part together, see
        :class:`~weft.operators.layout.PlacedLane`.
        """
        edges = self.inc.select(F.col("hv_id").alias("src"), F.col("he_id").alias("dst"))
        placed = placement.assign_partitions(edges, strategy, parts, threshold)
        inc = placed.select(F.col("dst").alias("he_id"), F.col("src").alias("hv_id"), "part")
        return HyperGraph(self.hv, self.he, inc, self.distinct)

    def settle(self, parts: int) -> HyperGraph:
        """Move each incidence to the Spark partition ``inc.part`` names."""
        return HyperGraph(self.hv, self.he, placement.settle(self.inc, parts), self.distinct)

    def partition_by(self, strategy: str, parts: int, threshold: int = placement.DEGREE_CUTOFF) -> HyperGraph:
        """:meth:`assign_parts` and :meth:`settle`."""
        return self.assign_parts(strategy, parts, threshold).settle(parts)

    # -- supersteps -------------------------------------------------------------------

    def compute(self, max_iters, initial, vertex_program, hyperedge_program, trace=None, frontier=None, traffic=None) -> HyperGraph:
        """See :func:`weft.operators.superstep.compute`."""
        return superstep.compute(self, max_iters, initial, vertex_program, hyperedge_program, trace, frontier, traffic)


@dataclass(frozen=True)
class Graph:
    """A one-mode property graph: ``v(id, attr)`` and ``e(src, dst, attr)``."""

    v: DataFrame
    e: DataFrame

    def map_vertices(self, f: Callable[[Column, Column], Column]) -> Graph:
        return Graph(structure.map_attr(self.v, f), self.e)

    def augment(self, value: Column) -> Graph:
        return Graph(structure.augment(self.v, value), self.e)

    def map_edges(self, f: Callable[[Column], Column]) -> Graph:
        return Graph(self.v, self.e.withColumn("attr", f(F.col("attr"))))

    def map_triplets(self, f: Callable[[Column, Column, Column], Column]) -> Graph:
        """Edge attributes become ``f(src_attr, attr, dst_attr)``."""
        t = self.triplets()
        attr = f(F.col("src_attr"), F.col("attr"), F.col("dst_attr")).alias("attr")
        return Graph(self.v, t.select("src", "dst", attr))

    def triplets(self) -> DataFrame:
        """``(src, src_attr, dst, dst_attr, attr)`` per edge."""
        src = self.v.select(F.col("id").alias("src"), F.col("attr").alias("src_attr"))
        dst = self.v.select(F.col("id").alias("dst"), F.col("attr").alias("dst_attr"))
        return self.e.join(src, "src").join(dst, "dst")

    def update_vertices(self, values: DataFrame, f: Predicate) -> Graph:
        return Graph(structure.update(self.v, values, f), self.e)

    def degrees(self, direction: str = "both") -> DataFrame:
        """``(id, degree)`` of the vertices with edges; direction ``in``, ``out`` or ``both``."""
        return structure.graph_degrees(self.e, direction)

    def aggregate_messages(
        self,
        to: str,
        message: Column,
        aggregate: Callable[[Column], Column],
        ends: tuple[str, ...] = (),
    ) -> DataFrame:
        """``(id, msg)``: ``message`` per edge, aggregated at its ``to`` end (``src`` or ``dst``).

        ``message`` may use the edge columns ``src, dst, attr`` and, for each end listed
        in ``ends``, ``src_attr`` / ``dst_attr``; an end that is not listed is not joined.
        """
        return structure.aggregate_messages(self, to, message, aggregate, ends)

    def normalize(self) -> Graph:
        """Scale edge weights so that each source's weights add up to 1."""
        return structure.normalize(self)

    def partition_by(self, strategy: str, parts: int, threshold: int = placement.DEGREE_CUTOFF) -> Graph:
        return Graph(self.v, placement.place(self.e, strategy, parts, threshold))
