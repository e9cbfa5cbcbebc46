"""Attribute maps, sub-hypergraphs, degrees and views."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.routes import merge_copies
from weft.operators.skew import apart
from weft.session import cut

if TYPE_CHECKING:
    from weft.model import Graph, HyperGraph


def id_shift(hv: DataFrame, he: DataFrame) -> int:
    """What hyperedge ids grow by so that the smallest follows the largest vertex id."""
    top = hv.agg(F.max("id")).first()[0]
    bottom, highest = he.agg(F.min("id"), F.max("id")).first()
    return shift_between(top, bottom, highest)


def shift_between(top: int | None, bottom: int | None, highest: int | None) -> int:
    if top is None or bottom is None:
        return 0
    shift = top - bottom + 1
    if not -(1 << 63) <= shift < 1 << 63 or highest + shift >= 1 << 63:
        raise ValueError(f"hyperedge ids {bottom}..{highest} do not fit behind vertex id {top} in 64 bits; renumber them")
    return shift


def validate(inc: DataFrame, hv: DataFrame, he: DataFrame) -> None:
    problems = []
    for key, nodes in (("hv_id", hv), ("he_id", he)):
        unknown = inc.join(apart(nodes.select(F.col("id").alias(key))), key, "left_anti").count()
        if unknown:
            problems.append(f"{unknown} incidences name an unknown {key}")
        repeated = nodes.groupBy("id").count().where("count > 1").count()
        if repeated:
            problems.append(f"{repeated} ids of {key} have several attribute rows")
    if problems:
        raise ValueError("; ".join(problems))


def map_attr(nodes: DataFrame, f) -> DataFrame:
    return nodes.withColumn("attr", f(F.col("id"), F.col("attr")))


def augment(nodes: DataFrame, value) -> DataFrame:
    return nodes.withColumn("attr", F.struct(F.col("attr").alias("_1"), value.alias("_2")))


def attach(nodes: DataFrame, values: DataFrame) -> DataFrame:
    values = values.select("id", F.col("attr").alias("_value"))
    pair = F.struct(F.col("attr").alias("_1"), F.col("_value").alias("_2"))
    return nodes.join(values, "id", "left").withColumn("attr", pair).drop("_value")


def update(nodes: DataFrame, values: DataFrame, f) -> DataFrame:
    """A repeated id among ``values`` fails the job: which value would win is not defined."""
    repeated = F.raise_error(F.concat(F.lit("several values for id "), F.col("id").cast("string")))
    values = values.groupBy("id").agg(F.first("value").alias("_value"), F.count("*").alias("_n"))
    values = values.select("id", "_value", F.when(F.col("_n") > 1, repeated.cast("boolean")).otherwise(F.lit(True)).alias("_has"))
    new = F.when(F.col("_has"), f(F.col("attr"), F.col("_value"))).otherwise(F.col("attr"))
    return nodes.join(values, "id", "left").withColumn("attr", new).drop("_value", "_has")


def links(graph: HyperGraph) -> DataFrame:
    if graph.layout:
        return graph.layout.links()
    if graph.distinct:
        return graph.inc.select("he_id", "hv_id", F.lit(1).cast("bigint").alias("copies"))
    return merge_copies(graph.inc, ["he_id", "hv_id"])


def nodes(graph: HyperGraph) -> DataFrame:
    tables = {"vertex": graph.hv, "hyperedge": graph.he}
    kinds = {role: table.schema["attr"].dataType for role, table in tables.items()}

    def tagged(role: str) -> DataFrame:
        attr = [
            (F.col("attr") if field == role else F.lit(None).cast(kind)).alias(field)
            for field, kind in kinds.items()
        ]
        return tables[role].select("id", F.lit(role).alias("role"), F.struct(*attr).alias("attr"))

    return tagged("vertex").unionByName(tagged("hyperedge"))


def triplets(graph: HyperGraph) -> DataFrame:
    hv = graph.hv.select(F.col("id").alias("hv_id"), F.col("attr").alias("hv_attr"))
    he = graph.he.select(F.col("id").alias("he_id"), F.col("attr").alias("he_attr"))
    return graph.inc.join(apart(hv), "hv_id").join(apart(he), "he_id").select("hv_id", "hv_attr", "he_id", "he_attr")


def summary(graph: HyperGraph) -> DataFrame:
    one = F.lit(1).alias("n")
    marks = [
        table.select(F.lit(name).alias("part"), one)
        for name, table in (("hv", graph.hv), ("he", graph.he), ("inc", graph.inc))
    ]
    count = {
        "num_vertices": F.count_if(F.col("part") == "hv"),
        "num_hyperedges": F.count_if(F.col("part") == "he"),
        "num_incidences": F.count_if(F.col("part") == "inc"),
    }
    rows = marks[0].union(marks[1]).union(marks[2])
    return rows.agg(*[c.alias(name) for name, c in count.items()])


def _with_degree(nodes: DataFrame, inc: DataFrame, key: str) -> DataFrame:
    counts = inc.groupBy(F.col(key).alias("id")).agg(F.count("*").cast("int").alias("_n"))
    attr = F.coalesce("_n", F.lit(0)).alias("attr")
    rest = [c for c in nodes.columns if c not in ("id", "attr")]
    return nodes.drop("attr").join(counts, "id", "left").select("id", attr, *rest)


def degrees(graph: HyperGraph) -> HyperGraph:
    return graph.with_tables(
        _with_degree(graph.hv, graph.inc, "hv_id"), _with_degree(graph.he, graph.inc, "he_id")
    )


def sub_hypergraph(graph: HyperGraph, vertex, hyperedge, retain_isolated: bool) -> HyperGraph:
    """One pass: removing nodes without incidences cannot isolate others.

    Semi joins only run for a side that is really filtered.
    """
    from weft.model import HyperGraph

    hv, he, inc = graph.hv, graph.he, graph.inc
    if vertex is not None:
        hv = hv.where(vertex(F.col("id"), F.col("attr")))
        inc = inc.join(apart(hv.select(F.col("id").alias("hv_id"))), "hv_id", "left_semi")
    if hyperedge is not None:
        he = he.where(hyperedge(F.col("id"), F.col("attr")))
        inc = inc.join(apart(he.select(F.col("id").alias("he_id"))), "he_id", "left_semi")
    inc = inc.select(*graph.inc.columns)
    if vertex is not None or hyperedge is not None:
        inc = cut(inc)  # read by both sides below and by whatever comes next
    if not retain_isolated:
        # Distinct ids first: the semi join then never meets a hot key.
        hv = hv.join(inc.select(F.col("hv_id").alias("id")).distinct(), "id", "left_semi")
        he = he.join(inc.select(F.col("he_id").alias("id")).distinct(), "id", "left_semi")
    return HyperGraph(hv, he, inc, graph.distinct)


def graph_degrees(edges: DataFrame, direction: str) -> DataFrame:
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    if len(ends) == 1:
        ids = edges.select(F.col(ends[0]).alias("id"))
    else:
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ids.groupBy("id").agg(F.count("*").cast("int").alias("degree"))


def aggregate_messages(graph: Graph, to: str, message, aggregate, ends: tuple[str, ...]) -> DataFrame:
    rows = graph.e
    for end in ends:
        attr = graph.v.select(F.col("id").alias(end), F.col("attr").alias(f"{end}_attr"))
        rows = rows.join(attr, end)
    sent = rows.select(F.col(to).alias("id"), message.alias("_msg"))
    return sent.groupBy("id").agg(aggregate(F.col("_msg")).alias("msg"))


def normalize(graph: Graph) -> Graph:
    """Out-weight totals joined back. A window would bring all edges of a source into
    one task. The edges are read twice, so they are written once first."""
    from weft.model import Graph

    edges = cut(graph.e)
    totals = apart(edges.groupBy("src").agg(F.sum("attr").alias("_total")))
    weight = (F.col("attr") / F.col("_total")).alias("attr")
    return Graph(graph.v, edges.join(totals, "src").select("src", "dst", weight))
