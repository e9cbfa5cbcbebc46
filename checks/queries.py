"""Every operator run over the given tables: ``name -> (spark, sf_dir) -> DataFrame``.

The main hypergraph takes orders as hyperedges and parts as vertices, one incidence per
order line; the set hypergraph merges orders with the same suppliers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import AllExcept, ArrowProgram, Fold, Graph, HyperGraph, Mode, Only, Program, Send, Step
from weft.functions import entropy_bits, wrapping_product
from weft.operators.ids import dense_ids
from weft.operators.placement import assign_partitions, partition_stats
from weft.operators.projection import Projection
from weft.plans import (
    connected_components,
    label_propagation,
    neighbour_counts,
    neighbour_registers,
    pagerank,
    pagerank_entropy,
    pagerank_graph,
    pagerank_on_graph,
    random_walk,
    shortest_path,
)
from weft.plans.pagerank import weight_per_member
from weft.session import cut, scratch_path
from weft.sources import from_groups, from_incidences, read_csv, read_records, records_hypergraph
from weft.sources.groups import merge_identical
from weft.sources.records import count_forms

CATALOGUE = {}

DIGITS = 6  # doubles are compared after rounding: sums come in another order elsewhere


def query(f):
    CATALOGUE[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("he_id"), F.col("l_partkey").alias("hv_id")
    )


def orders_parts(spark, sf, vertex_attr="p_name") -> HyperGraph:
    """Orders as hyperedges with ``struct(card, weight=1)``, parts as vertices."""
    graph = HyperGraph.from_tables(
        order_lines(spark, sf),
        table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col(vertex_attr).alias("attr")),
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
    )
    sized = graph.degrees().map_hyperedges(
        lambda _, n: F.struct(n.alias("card"), F.lit(1).alias("weight"))
    )
    return graph.with_tables(graph.hv, sized.he)


def order_suppliers(spark, sf) -> HyperGraph:
    """Orders merged by their set of suppliers, ``struct(card, weight=number of orders)``."""
    return from_groups(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


def lines_as_edges(spark, sf) -> DataFrame:
    return order_lines(spark, sf).select(F.col("hv_id").alias("src"), F.col("he_id").alias("dst"))


def sized(he: DataFrame) -> DataFrame:
    return he.select("id", "attr.card", "attr.weight")


def rounded(column, name) -> F.Column:
    return F.round(column, DIGITS).alias(name)


def both(graph: HyperGraph, name: str, digits: bool = False) -> DataFrame:
    """``(id, name)`` of all nodes from attributes ``struct(_1, _2)``."""
    value = rounded(F.col("attr._2"), name) if digits else F.col("attr._2").alias(name)
    return graph.hv.select("id", value).unionByName(graph.he.select("id", value))


# -- sources, sinks, ids ------------------------------------------------------------------


@query
def hg_summary(spark, sf):
    return orders_parts(spark, sf).summary()


@query
def vertex_table(spark, sf):
    return orders_parts(spark, sf).hv


@query
def hyperedge_table(spark, sf):
    return orders_parts(spark, sf).he.select("id", "orig_id", "attr.card", "attr.weight")


@query
def all_nodes(spark, sf):
    nodes = orders_parts(spark, sf).nodes()
    name = F.coalesce("attr.vertex", F.concat(F.lit("order of "), F.col("attr.hyperedge.card"))).alias("name")
    return nodes.select("id", "role", name)


@query
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "round-trip")
    orders_parts(spark, sf).write_parquet(path)
    return sized(HyperGraph.read_parquet(spark, path).he)


@query
def csv_incidence(spark, sf):
    path = scratch_path(spark, "incidence-csv")
    order_lines(spark, sf).write.csv(path)
    return sized(read_csv(spark, path).he)


def record_lines(spark, sf) -> DataFrame:
    """Record lines ``["order-line", "year", ["part", "supplier", flag]]`` made from order lines.

    Line number 6 becomes broken JSON, 5 a year that is a number, 4 lists an author
    twice and one that is no string.
    """
    line = table(spark, sf, "lineitem")
    title = F.format_string('"%d-%d"', "l_orderkey", "l_linenumber")
    year = F.year("l_shipdate").cast("string")
    part = F.format_string('"P%d"', F.col("l_partkey"))
    supplier = F.format_string('"S%d"', F.col("l_suppkey"))
    number = F.col("l_linenumber")
    quoted = F.when(number == 5, year).otherwise(F.concat(F.lit('"'), year, F.lit('"')))
    authors = F.when(
        number == 4, F.concat_ws(",", supplier, part, F.lit("17"), supplier)
    ).otherwise(F.concat_ws(",", part, supplier))
    end = F.when(number == 6, F.lit("]")).otherwise(F.lit("]]"))
    return line.select(
        F.concat(F.lit("["), title, F.lit(", "), quoted, F.lit(", ["), authors, end).alias("value")
    )


@query
def json_records(spark, sf):
    path = scratch_path(spark, "records-json")
    record_lines(spark, sf).write.text(path)
    return read_records(spark, path, since=1997).select(
        "title", "year", F.array_join(F.array_sort("authors"), "+").alias("authors")
    )


@query
def record_forms(spark, sf):
    return count_forms(record_lines(spark, sf))


@query
def json_hypergraph(spark, sf):
    path = scratch_path(spark, "records-json")
    record_lines(spark, sf).write.text(path)
    graph = records_hypergraph(read_records(spark, path, since=1997))
    names = graph.triplets().groupBy("he_id", "he_attr").agg(
        F.min("hv_attr").alias("first_author"), F.max("hv_attr").alias("last_author")
    )
    return names.select("first_author", "last_author", "he_attr.card", "he_attr.weight")


@query
def groups_to_hypergraph(spark, sf):
    return order_suppliers(spark, sf).triplets().select(
        "hv_id", F.col("hv_attr").alias("supplier"), "he_id", "he_attr.card", "he_attr.weight"
    )


@query
def member_sets(spark, sf):
    """Per set of suppliers: cardinality, number of orders, smallest order, sum of its suppliers."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record"),
        F.col("l_orderkey").alias("label"),
        F.col("l_suppkey").alias("member"),
    )
    members, sets = merge_identical(cut(rows.distinct()))
    sums = members.groupBy("set").agg(F.sum("member").alias("suppliers"))
    return sets.join(sums, "set").select("label", "card", "weight", "suppliers")


@query
def max_cardinality_filter(spark, sf):
    graph = from_incidences(order_lines(spark, sf), max_cardinality=3)
    return graph.degrees().he.select("id", "attr").unionByName(graph.degrees().hv.select("id", "attr"))


@query
def min_cardinality_filter(spark, sf):
    graph = from_incidences(order_lines(spark, sf), min_cardinality=5)
    return graph.degrees().he.select("id", "attr").unionByName(graph.degrees().hv.select("id", "attr"))


@query
def id_shift(spark, sf):
    return orders_parts(spark, sf).he.select("orig_id", "id")


@query
def dense_id_table(spark, sf):
    names = table(spark, sf, "customer").select("c_mktsegment", "c_name").distinct()
    return dense_ids(names, ["c_mktsegment", "c_name"])


@query
def min_id_max_id(spark, sf):
    graph = orders_parts(spark, sf)
    return graph.nodes().groupBy("role").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"))


# -- attributes and structure -------------------------------------------------------------


@query
def map_vertices(spark, sf):
    graph = orders_parts(spark, sf)
    return graph.map_vertices(lambda id, attr: F.concat_ws(":", id, F.upper(attr))).hv


@query
def map_hyperedges(spark, sf):
    graph = orders_parts(spark, sf)
    return graph.map_hyperedges(lambda id, attr: id * 10 + attr["card"]).he.select("id", "attr")


@query
def augment(spark, sf):
    graph = orders_parts(spark, sf).augment(F.lit(1.5), F.lit("x"))
    return graph.hv.select("id", "attr._1", F.col("attr._2").cast("string").alias("_2")).unionByName(
        graph.he.select("id", F.col("attr._1.card").cast("string").alias("_1"), "attr._2")
    )


@query
def strip(spark, sf):
    graph = orders_parts(spark, sf).augment(F.lit(1.5), F.lit("x")).strip()
    return graph.hv


@query
def update_subset(spark, sf):
    graph = orders_parts(spark, sf)
    flagged = (
        table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id"))
        .agg(F.sum("l_quantity").cast("bigint").alias("value"))
    )
    return graph.update_vertices(flagged, lambda attr, value: F.concat_ws("/", attr, value)).hv


def _small_parts(_, size):
    return size <= 25


def _middle_orders(_, attr):
    return (attr["card"] >= 2) & (attr["card"] <= 4)


def _sizes(graph):
    degrees = graph.degrees()
    return degrees.hv.select("id", "attr").unionByName(degrees.he.select("id", "attr"))


@query
def sub_hypergraph(spark, sf):
    return _sizes(orders_parts(spark, sf, "p_size").sub_hypergraph(_small_parts, _middle_orders))


@query
def sub_hypergraph_keep_isolated(spark, sf):
    graph = orders_parts(spark, sf, "p_size")
    return _sizes(graph.sub_hypergraph(_small_parts, _middle_orders, retain_isolated=True))


@query
def degrees(spark, sf):
    return _sizes(orders_parts(spark, sf))


@query
def dual_degrees(spark, sf):
    dual = orders_parts(spark, sf).dual().degrees()
    return dual.hv.select("id", F.lit("vertex").alias("role"), F.col("attr").alias("degree")).unionByName(
        dual.he.select("id", F.lit("hyperedge").alias("role"), F.col("attr").alias("degree"))
    )


@query
def triplets(spark, sf):
    return orders_parts(spark, sf).triplets().select("hv_id", "hv_attr", "he_id", "he_attr.card")


# -- one-mode graphs ----------------------------------------------------------------------


@query
def to_graph_sum(spark, sf):
    return orders_parts(spark, sf).to_graph(weight_per_member, "sum").e.select("src", "dst", rounded(F.col("attr"), "attr"))


@query
def to_graph_max(spark, sf):
    return orders_parts(spark, sf).to_graph(lambda attr: attr["card"], "max").e


@query
def to_graph_custom_fold(spark, sf):
    """A fold with no built-in aggregate: bitwise or, plus the larger of the two values."""
    return orders_parts(spark, sf).to_graph(
        lambda attr: F.struct(
            F.call_function("shiftleft", F.lit(1), attr["card"]).alias("bits"), attr["card"].alias("top")
        ),
        Fold(
            lambda a, b: F.struct(
                a["bits"].bitwiseOR(b["bits"]).alias("bits"), F.greatest(a["top"], b["top"]).alias("top")
            )
        ),
    ).e.select("src", "dst", "attr.bits", "attr.top")


def purchase_graph(spark, sf) -> Graph:
    """A one-mode graph of orders and parts: an order points to the part of each of its lines.

    Vertex ids: parts as they are, orders behind them. Vertex attributes: part sizes,
    and the number of an order's customer. Edge attributes: quantities.
    """
    graph = HyperGraph.from_tables(
        order_lines(spark, sf),
        table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("attr")),
        table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("attr")
        ),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orig_id"), F.col("l_partkey").alias("dst"),
        F.col("l_quantity").cast("int").alias("attr"),
    )
    edges = lines.join(graph.he.select("orig_id", F.col("id").alias("src")), "orig_id")
    vertices = graph.hv.select("id", "attr").unionByName(graph.he.select("id", "attr"))
    return Graph(vertices, edges.select("src", "dst", "attr"))


@query
def graph_degrees(spark, sf):
    return purchase_graph(spark, sf).degrees("both")


@query
def graph_in_out_degrees(spark, sf):
    graph = purchase_graph(spark, sf)
    return (
        graph.degrees("in").withColumn("direction", F.lit("in"))
        .unionByName(graph.degrees("out").withColumn("direction", F.lit("out")))
    )


@query
def graph_map_vertices(spark, sf):
    graph = purchase_graph(spark, sf).map_vertices(lambda id, attr: id + attr)
    return graph.augment(F.lit(7)).v.select("id", "attr._1", "attr._2")


@query
def graph_map_edges(spark, sf):
    return purchase_graph(spark, sf).map_triplets(lambda a, quantity, b: a * 1000 + b * 10 + quantity).e


@query
def graph_update_vertices(spark, sf):
    graph = purchase_graph(spark, sf)
    values = graph.degrees("in").withColumnRenamed("degree", "value")
    return graph.update_vertices(values, lambda attr, degree: attr * 100 + degree).v


@query
def aggregate_messages(spark, sf):
    return purchase_graph(spark, sf).aggregate_messages(
        "dst", F.col("src_attr") * F.col("attr"), F.sum, ("src",)
    )


@query
def out_weights(spark, sf):
    return purchase_graph(spark, sf).aggregate_messages("src", F.col("attr"), F.sum)


@query
def normalized_purchases(spark, sf):
    graph = purchase_graph(spark, sf).map_edges(lambda quantity: quantity.cast("double")).normalize()
    return graph.e.select("src", "dst", rounded(F.col("attr"), "attr"))


@query
def normalized_graph(spark, sf):
    return pagerank_graph(order_suppliers(spark, sf)).e.select("src", "dst", rounded(F.col("attr"), "attr"))


# -- aggregations -------------------------------------------------------------------------


@query
def entropy_by_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        rounded(entropy_bits(F.col("l_quantity")), "entropy")
    )


@query
def mode_label(spark, sf):
    """The supplier each part is most often bought from."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("dst_id"), F.col("l_suppkey").alias("msg"), F.lit(1).alias("copies")
    )
    return Mode().merge(rows).select(F.col("dst_id").alias("part"), F.col("msg").alias("supplier"))


@query
def neighbours_exact(spark, sf):
    return neighbour_counts(orders_parts(spark, sf), exact=True)


@query
def neighbours_hll(spark, sf):
    return neighbour_counts(orders_parts(spark, sf))


@query
def sketch_registers(spark, sf):
    """The registers from which neighbour counts are estimated, row by row."""
    return neighbour_registers(orders_parts(spark, sf))


# -- supersteps ---------------------------------------------------------------------------

def zero():
    return F.lit(0).cast("bigint")


def _heard(graph: HyperGraph, sends, combiner="sum") -> DataFrame:
    """What hyperedges hear when vertices send once: ``(id, heard)``, -1 for nothing."""
    def vertex(superstep, id, attr, msg):
        return Step(sends=sends(id, attr))

    def hyperedge(superstep, id, attr, msg):
        return Step(msg)

    start = graph.map_hyperedges(lambda *_: F.lit(-1).cast("bigint"))
    done = start.compute(1, zero(), Program(vertex, combiner), Program(hyperedge, combiner))
    return done.he.select("id", F.col("attr").alias("heard"))


def _with_ends(spark, sf) -> HyperGraph:
    """Vertices know their first and last hyperedge."""
    graph = orders_parts(spark, sf)
    ends = graph.inc.groupBy(F.col("hv_id").alias("id")).agg(
        F.struct(F.min("he_id").alias("first"), F.max("he_id").alias("last")).alias("attr")
    )
    hv = graph.attach(ends, graph.he).hv.select("id", "attr._2")
    return graph.with_tables(hv.withColumnRenamed("_2", "attr"), graph.he)


@query
def recipients_only(spark, sf):
    return _heard(
        _with_ends(spark, sf),
        lambda id, ends: [Send(id, Only(F.array(ends["first"], ends["last"])), ends.isNotNull())],
    )


@query
def recipients_except(spark, sf):
    return _heard(
        _with_ends(spark, sf),
        lambda id, ends: [Send(id, AllExcept(F.array(ends["first"], ends["last"])), ends.isNotNull())],
    )


@query
def recipients_table(spark, sf):
    """Parts reach only the orders that returned them: pairs from a table."""
    graph = orders_parts(spark, sf)
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    pairs = lines.join(graph.he.select("id", "orig_id"), F.col("l_orderkey") == F.col("orig_id"))
    pairs = pairs.select(F.col("l_partkey").alias("sender"), F.col("id").alias("receiver"))
    return _heard(graph, lambda id, _: [Send(id, Only(pairs))])


@query
def recipients_table_except(spark, sf):
    """Every part reaches the orders that a table does not name."""
    graph = orders_parts(spark, sf)
    closed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    closed = closed.join(graph.he.select("id", "orig_id"), F.col("o_orderkey") == F.col("orig_id"))
    return _heard(graph, lambda id, _: [Send(id, AllExcept(closed.select(F.col("id").alias("receiver"))))])


@query
def message_by_destination(spark, sf):
    return _heard(orders_parts(spark, sf, "p_size"), lambda id, size: [Send(lambda dst: dst * size - id)])


@query
def multi_send(spark, sf):
    return _heard(
        orders_parts(spark, sf, "p_size"),
        lambda id, size: [
            Send(F.lit(1).cast("bigint")),
            Send(size.cast("bigint") * 100, when=size > 25),
            Send(lambda dst: dst),
        ],
    )


@query
def conditional_send(spark, sf):
    return _heard(
        orders_parts(spark, sf, "p_size"), lambda id, size: [Send(id, when=size > 40)], "max"
    )


@query
def default_combiner_map(spark, sf):
    """Histogram of part brands per order, as a map message with the implied combiner."""
    graph = orders_parts(spark, sf, "p_brand").map_hyperedges(
        lambda *_: F.lit(None).cast("map<string,bigint>")
    )

    def vertex(superstep, id, brand, msg):
        return Step(sends=[Send(F.create_map(brand, F.lit(1).cast("bigint")))])

    def hyperedge(superstep, id, attr, msg):
        return Step(msg)

    done = graph.compute(1, zero(), Program(vertex), Program(hyperedge, "sum"))
    return done.he.select("id", F.explode("attr").alias("brand", "n"))


@query
def folded_messages(spark, sf):
    """An arbitrary binary combiner: the largest and the bitwise-or of part sizes per order."""
    graph = orders_parts(spark, sf, "p_size").map_hyperedges(
        lambda *_: F.lit(None).cast("struct<top:int,bits:int>")
    )

    def join(a, b):
        return F.struct(
            F.greatest(a["top"], b["top"]).alias("top"), a["bits"].bitwiseOR(b["bits"]).alias("bits")
        )

    def vertex(superstep, id, size, msg):
        return Step(sends=[Send(F.struct(size.alias("top"), size.alias("bits")))])

    def hyperedge(superstep, id, attr, msg):
        return Step(msg)

    done = graph.compute(1, zero(), Program(vertex, join), Program(hyperedge, "sum"))
    found = [F.coalesce(F.col(f"attr.{name}"), F.lit(-1)).alias(name) for name in ("top", "bits")]
    return done.he.select("id", *found)


@query
def nested_map_messages(spark, sf):
    """Brands, in them sizes, in them a count and a sum: a map of maps of structs per order."""
    kind = "map<string,map<int,struct<n:bigint,total:bigint>>>"
    graph = orders_parts(spark, sf, "p_brand")
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"))
    graph = graph.update_vertices(sizes.select("id", F.col("value").cast("string").alias("value")), lambda brand, size: F.concat_ws("|", brand, size))
    graph = graph.map_hyperedges(lambda *_: F.lit(None).cast(kind))

    def vertex(superstep, id, attr, msg):
        brand, size = F.split_part(attr, F.lit("|"), F.lit(1)), F.split_part(attr, F.lit("|"), F.lit(2)).cast("int")
        leaf = F.struct(F.lit(1).cast("bigint").alias("n"), size.cast("bigint").alias("total"))
        return Step(sends=[Send(F.create_map(brand, F.create_map(size, leaf)))])

    def hyperedge(superstep, id, attr, msg):
        return Step(msg)

    done = graph.compute(1, zero(), Program(vertex), Program(hyperedge, "sum"))
    rows = done.he.select("id", F.explode("attr").alias("brand", "sizes"))
    return rows.select("id", "brand", F.explode("sizes").alias("size", "leaf")).select("id", "brand", "size", "leaf.n", "leaf.total")


@query
def list_messages(spark, sf):
    """A struct with a list and a sum per order; both implied by the message type."""
    graph = orders_parts(spark, sf, "p_size").map_hyperedges(
        lambda *_: F.lit(None).cast("struct<ids:array<bigint>,total:bigint>")
    )

    def vertex(superstep, id, size, msg):
        return Step(sends=[Send(F.struct(F.array(id).alias("ids"), (id * size).alias("total")))])

    def hyperedge(superstep, id, attr, msg):
        return Step(msg)

    done = graph.compute(1, zero(), Program(vertex), Program(hyperedge, "sum")).he.where("attr is not null")
    return done.select("id", F.size("attr.ids").cast("bigint").alias("n"), "attr.total", F.array_min("attr.ids").alias("low"))


def flagged_lots(spark, sf) -> HyperGraph:
    """Orders as vertices; a hyperedge for each supplier and return flag, hundreds of orders in it."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lots = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 3 + flag).alias("he_id"), F.col("l_orderkey").alias("hv_id"))
    return HyperGraph.from_tables(
        lots.distinct(), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), lots.select(F.col("he_id").alias("id")).distinct(), distinct=True
    )


def close_to_exact(graph: HyperGraph, estimates: DataFrame) -> DataFrame:
    """Whether each estimate is within 8 % (five standard errors) of the exact count."""
    exact = neighbour_counts(graph, exact=True)
    near = F.abs(F.col("estimate") - F.col("neighbours")) <= 0.08 * F.col("neighbours")
    return exact.join(estimates, "id").select("id", near.alias("close"))


@query
def neighbours_wide(spark, sf):
    """Neighbour counts far beyond what a sketch counts exactly."""
    graph = flagged_lots(spark, sf)
    return close_to_exact(graph, neighbour_counts(graph).select("id", "estimate"))


@query
def neighbours_exact_wide(spark, sf):
    """Exact counts where most hyperedges are beyond the limit; they share so little that what two of them share is counted."""
    return neighbour_counts(flagged_lots(spark, sf), exact=True, heavy=200)


@query
def sketch_messages(spark, sf):
    """The same as a program: sketches are messages, united by the combiner that their type implies.

    A vertex keeps the estimate of what it hears and no longer its own sketch: united sketches are 4 KB each.
    """
    graph = flagged_lots(spark, sf)
    own = graph.hv.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(12)).alias("sketch"))
    own = own.select("id", F.struct("sketch", F.lit(None).cast("bigint").alias("estimate")).alias("attr"))
    graph = graph.with_tables(own, graph.he.withColumn("attr", F.lit(None).cast("binary")))

    def vertex(superstep, id, attr, msg):
        if superstep == 0:
            return Step(sends=[Send(attr["sketch"])])
        return Step(F.struct(F.lit(None).cast("binary").alias("sketch"), F.hll_sketch_estimate(msg).alias("estimate")))

    def hyperedge(superstep, id, attr, msg):
        return Step(msg, [Send(msg)])

    done = graph.compute(2, F.lit(None).cast("binary"), Program(vertex), Program(hyperedge))
    alone = graph.links().select(F.col("hv_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    found = done.hv.join(alone, "id", "left")
    heard = F.coalesce("attr.estimate", F.hll_sketch_estimate("attr.sketch"))
    estimate = F.when(F.col("linked"), heard).otherwise(0)
    return close_to_exact(graph, found.select("id", estimate.alias("estimate")))


# -- algorithms ---------------------------------------------------------------------------


@query
def connected_components_labels(spark, sf):
    return both(connected_components(orders_parts(spark, sf)), "label")


def few_lines(spark, sf) -> HyperGraph:
    """Orders of one or two lines: many components, some of them long."""
    return orders_parts(spark, sf).sub_hypergraph(hyperedge=lambda _, attr: (attr["card"] > 0) & (attr["card"] <= 2))


@query
def components_small(spark, sf):
    return both(connected_components(few_lines(spark, sf)), "label")


@query
def components_small_dual(spark, sf):
    return both(connected_components(few_lines(spark, sf).dual()), "label")


def order_chains(spark, sf) -> HyperGraph:
    """Each order joins itself and its successor, in runs of a thousand keys."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    later = orders.select((F.col("id") - 1).alias("he_id"), F.col("id").alias("hv_id")).where("id % 1000 <> 0")
    later = later.join(orders.select(F.col("id").alias("he_id")), "he_id", "left_semi")
    return HyperGraph.from_tables(orders.select(F.col("id").alias("he_id"), F.col("id").alias("hv_id")).union(later), orders, orders)


@query
def components_chain(spark, sf):
    """Components whose chains are a thousand links long."""
    return both(connected_components(order_chains(spark, sf)), "label")


@query
def label_propagation_labels(spark, sf):
    return both(label_propagation(orders_parts(spark, sf), 3), "label")


@query
def pagerank_ranks(spark, sf):
    return both(pagerank(orders_parts(spark, sf), 5), "rank", digits=True)


@query
def pagerank_weighted(spark, sf):
    return both(pagerank(order_suppliers(spark, sf), 5), "rank", digits=True)


@query
def pagerank_entropy_values(spark, sf):
    graph = pagerank_entropy(orders_parts(spark, sf), 4)
    return graph.he.select(
        "id", rounded(F.col("attr._2.rank"), "rank"), rounded(F.col("attr._2.entropy"), "entropy")
    )


@query
def pagerank_on_projection(spark, sf):
    """PageRank on the listed one-mode graph."""
    graph = pagerank_on_graph(pagerank_graph(order_suppliers(spark, sf)), 3)
    return graph.v.select("id", rounded(F.col("attr._2"), "rank"))


@query
def pagerank_factored(spark, sf):
    """PageRank on the one-mode graph without listing its edges."""
    ranks = Projection(orders_parts(spark, sf), weight_per_member).pagerank(3)
    return ranks.select("id", rounded(F.col("rank"), "rank"))


@query
def random_walk_values(spark, sf):
    return both(random_walk(orders_parts(spark, sf), 4, [1, 4], 0.15, 1e-4), "value", digits=True)


@query
def shortest_path_hops(spark, sf):
    return both(shortest_path(orders_parts(spark, sf), 10, 1), "distance")


@query
def shortest_path_prepared(spark, sf):
    """Two runs on incidences that are laid out once: distances from two parts."""
    graph = orders_parts(spark, sf).prepare()
    near, far = (both(shortest_path(graph, 6, source), name) for source, name in ((1, "first"), (2, "second")))
    graph.release()
    return near.join(far, "id")


@query
def frontier_sizes(spark, sf):
    """Per half step of a shortest path: nodes that heard something, and nodes it brought nearer."""
    rows: list[tuple[int, int, int]] = []
    shortest_path(orders_parts(spark, sf), 4, 1, frontier=rows)
    return spark.createDataFrame(rows, "half_step int, reached bigint, sent bigint")


@query
def pagerank_placed(spark, sf):
    """PageRank with messages combined inside the parts of a grid first."""
    return both(pagerank(orders_parts(spark, sf).assign_parts("2D", 12), 5), "rank", digits=True)


@query
def shortest_path_placed(spark, sf):
    return both(shortest_path(orders_parts(spark, sf).assign_parts("HybridSrc", PARTS, CUTOFF), 10, 1), "distance")


@query
def messages_by_strategy(spark, sf):
    """Rows that travel per half step of a shortest path, as each strategy places the incidences."""
    graph, rows = orders_parts(spark, sf), []
    for strategy in ("1D-src", "1D-dst", "2D", "RandomVertexCut", "HybridSrc"):
        traffic: list[tuple[int, int, int]] = []
        shortest_path(graph.assign_parts(strategy, PARTS, CUTOFF), 2, 1, traffic=traffic)
        rows += [(strategy, *row) for row in traffic]
    return spark.createDataFrame(rows, "strategy string, half_step int, copies bigint, messages bigint")


SENDS = pa.list_(pa.struct([("to", pa.int64()), ("msg", pa.float64())]))


@query
def median_messages(spark, sf):
    """Orders take the median size of their parts (numpy over Arrow batches), parts the largest such median."""
    def median(superstep, batch):
        """The median of each node's list of numbers, kept and sent to whoever is incident."""
        medians = [float(np.median(x)) for x in batch.column("msg").to_pylist()]
        sends = pa.array([[{"to": None, "msg": x}] for x in medians], SENDS)
        return pa.table({"id": batch.column("id"), "attr": pa.array(medians), "sends": sends})

    def size(superstep, id, attr, msg):
        if superstep == 0:
            return Step(sends=[Send(F.array(attr))])
        return Step(msg)

    graph = orders_parts(spark, sf, "p_size").map_vertices(lambda _, a: a.cast("double")).map_hyperedges(lambda *_: F.lit(None).cast("double"))
    done = graph.compute(None, F.lit(0.0), Program(size, "concat"), ArrowProgram(median, "double", "max"))
    return done.hv.select("id", F.col("attr").alias("median")).unionByName(done.he.select("id", F.col("attr").alias("median")))


@query
def parquet_by_part(spark, sf):
    """Incidences of the largest parts, read back from a store that is laid out by part."""
    graph = orders_parts(spark, sf, "p_size")
    path = scratch_path(spark, "store")
    graph.assign_parts("1D-src", PARTS, CUTOFF).write_parquet(path)
    found = HyperGraph.read_parquet(spark, path, graph.hv.where("attr = 50").select("id"))
    return found.inc.groupBy("he_id", "hv_id", "part").agg(F.count("*").alias("copies"))


@query
def shortest_path_sum(spark, sf):
    return both(shortest_path(orders_parts(spark, sf), 4, 1, "sum"), "distance", digits=True)


# -- placement ----------------------------------------------------------------------------

PARTS = 12
CUTOFF = 30

PLACEMENTS = {
    "part_1d_src": ("1D-src", PARTS, CUTOFF),
    "part_1d_dst": ("1D-dst", PARTS, CUTOFF),
    "part_2d": ("2D", 16, CUTOFF),
    "part_2d_uneven": ("2D", PARTS, CUTOFF),
    "part_random": ("RandomVertexCut", PARTS, CUTOFF),
    "part_canonical": ("CanonicalRandomVertexCut", PARTS, CUTOFF),
    "part_default": ("Default", PARTS, CUTOFF),
    "part_hybrid_src": ("HybridSrc", PARTS, CUTOFF),
    "part_hybrid_dst": ("HybridDst", PARTS, 4),
    "part_greedy_src": ("GreedySrc", PARTS, CUTOFF),
    "part_greedy_dst": ("GreedyDst", PARTS, CUTOFF),
    "part_greedy_src_rounds": ("GreedySrc", PARTS, CUTOFF, 5),
    "part_greedy_dst_rounds": ("GreedyDst", PARTS, CUTOFF, 40),
}


def _placement(strategy, parts, cutoff, rounds=16):
    def run(spark, sf):
        return assign_partitions(lines_as_edges(spark, sf), strategy, parts, cutoff, rounds)

    return run


def wide_edges(spark, sf) -> DataFrame:
    """Edges whose ids are spread over all 64 bits: products with large numbers, modulo 2^64."""
    src = wrapping_product(F.col("hv_id"), -4611686018427387)
    dst = wrapping_product(F.col("he_id"), 2654435761 * 4294967291)
    return order_lines(spark, sf).select(src.alias("src"), dst.alias("dst"))


@query
def part_default_wide_ids(spark, sf):
    return assign_partitions(wide_edges(spark, sf), "Default", PARTS)


@query
def part_hybrid_wide_ids(spark, sf):
    return assign_partitions(wide_edges(spark, sf), "HybridDst", PARTS, 4)


for _name, _arguments in PLACEMENTS.items():
    CATALOGUE[_name] = _placement(*_arguments)


@query
def part_settled(spark, sf):
    """Spark partition in which each incidence lies after placement."""
    inc = orders_parts(spark, sf).partition_by("HybridDst", PARTS, 4).inc
    return inc.select("he_id", "hv_id", F.spark_partition_id().alias("partition"))


@query
def csv_placed(spark, sf):
    """Load, place and bound in one go: incidences per part."""
    path = scratch_path(spark, "incidence-csv")
    order_lines(spark, sf).write.csv(path)
    graph = read_csv(spark, path, max_cardinality=4, partition=("HybridSrc", PARTS, CUTOFF))
    return graph.inc.groupBy("part").agg(F.count("*").alias("incidences"))


@query
def components_of_dual(spark, sf):
    return both(connected_components(orders_parts(spark, sf).dual()), "label")


@query
def partition_statistics(spark, sf):
    placed = assign_partitions(lines_as_edges(spark, sf), "HybridSrc", PARTS, CUTOFF)
    stats = partition_stats(placed)
    means = [rounded(F.col(c), c) for c in ("parts_per_src", "parts_per_dst")]
    return stats.select("edges", "parts_used", "largest_part", *means)
