"""Incidence lists: CSV files of ``hyperedge,vertex`` lines, or any table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import HyperGraph
from weft.operators.structure import shift_between
from weft.session import cut


def from_incidences(
    inc: DataFrame,
    min_cardinality: int | None = None,
    max_cardinality: int | None = None,
    partition: tuple[str, int, int] | None = None,
) -> HyperGraph:
    """Hypergraph of the pairs ``inc(he_id, hv_id)``.

    Hyperedge attributes are ``struct(card INT, weight INT = 1)`` where ``card`` counts
    rows, repeated ones too. A bound keeps only the hyperedges within it and the
    vertices they touch; ``card`` is not recomputed. ``partition=(strategy, parts,
    threshold)`` goes by the degrees before that, and moves what is left.
    """
    card = F.struct(F.count("*").cast("int").alias("card"), F.lit(1).alias("weight"))
    he = inc.groupBy(F.col("he_id").alias("id")).agg(card.alias("attr"))
    hv = inc.select(F.col("hv_id").alias("id")).distinct()
    shift = shift_between(*inc.agg(F.max("hv_id"), F.min("he_id"), F.max("he_id")).first())
    graph = HyperGraph.from_tables(inc, hv, he, shift=shift)
    if partition:
        graph = graph.assign_parts(*partition)

    def within(_, attr):
        bound = F.lit(True)
        if min_cardinality is not None:
            bound = bound & (attr["card"] >= min_cardinality)
        if max_cardinality is not None:
            bound = bound & (attr["card"] <= max_cardinality)
        return bound

    if min_cardinality is not None or max_cardinality is not None:
        graph = graph.sub_hypergraph(hyperedge=within)
    return graph.settle(partition[1]) if partition else graph


def cardinality_bounds(argument: int) -> dict[str, int]:
    """Bounds encoded in one number: ``n > 0`` means at most n members, otherwise at least ``-n``."""
    return {"max_cardinality": argument} if argument > 0 else {"min_cardinality": -argument}


def read_csv(
    spark: SparkSession,
    path: str,
    min_cardinality: int | None = None,
    max_cardinality: int | None = None,
    partition: tuple[str, int, int] | None = None,
) -> HyperGraph:
    """Read ``hyperedge,vertex`` lines of two 64-bit ids. A malformed line fails the job."""
    rows = (
        spark.read.schema("he_id BIGINT, hv_id BIGINT")
        .option("mode", "FAILFAST")
        .option("columnPruning", "false")  # otherwise a bad line passes where a column is unused
        .csv(path)
    )
    missing = F.raise_error(F.lit("an incidence line lacks an id")).cast("bigint")
    inc = cut(rows.select(*[F.coalesce(c, missing).alias(c) for c in rows.columns]))  # text is parsed once
    return from_incidences(inc, min_cardinality, max_cardinality, partition)
