"""Alternating vertex / hyperedge supersteps.

One *half step* is one Spark job: senders join their links (no shuffle, see
:mod:`weft.operators.layout`), messages are pre-aggregated and shuffled once
by destination, joined to the destination's state, and the destination's program runs
as Column expressions. The new values of the nodes that heard something, and only those, go
to the checkpoint folder, so plans stay small and a lost executor costs no earlier half
step; values that were replaced are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import ExitStack
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.operators.combiners import Aggregate, Combiner, default_combiner, resolve
from weft.operators.layout import Lane, Layout, NodeState, PlacedLane, loop_session
from weft.operators.near import SETTINGS, SLOT, NearLane, parts_for, rows_shipped
from weft.operators.skew import hot_keys
from weft.session import cut

if TYPE_CHECKING:
    from weft.model import HyperGraph


@dataclass(frozen=True)
class Everyone:
    """All incident nodes."""


@dataclass(frozen=True)
class Only:
    """Incident nodes among ``ids``: Python ints, an array Column, or a frame.

    A frame ``(sender, receiver)`` lists pairs, one with ``receiver`` alone nodes that any
    sender may reach. It may be of any size, with repeated rows; null ids match nothing.
    """

    ids: Iterable[int] | Column | DataFrame


@dataclass(frozen=True)
class AllExcept:
    """Incident nodes not among ``ids``, which are given as for :class:`Only`."""

    ids: Iterable[int] | Column | DataFrame


@dataclass(frozen=True)
class Send:
    """One outgoing message.

    ``payload`` is a Column over the sender, or a function of the destination id
    (a Column) returning one; ``when`` limits which senders send.
    """

    payload: Column | Callable[[Column], Column]
    to: Everyone | Only | AllExcept = Everyone()
    when: Column | None = None


@dataclass(frozen=True)
class Step:
    """What a node does in a superstep: its new attribute (``None`` keeps it) and its sends."""

    become: Column | None = None
    sends: list[Send] = field(default_factory=list)


#: ``(superstep: int, id, attr, msg) -> Step``; all but the first are Columns.
StepFunction = Callable[[int, Column, Column, Column], Step]


@dataclass(frozen=True)
class Program:
    """A step function and the combiner of the messages it *sends*.

    ``combiner=None`` takes the combiner implied by the message type.
    """

    step: StepFunction
    combiner: Combiner | str | Callable[[Column, Column], Column] | None = None


@dataclass(frozen=True)
class ArrowProgram:
    """A program for what no Column expresses: a function of Arrow batches.

    ``step(superstep, batch)`` gets a record batch ``(id, attr, msg)`` of nodes that run, and
    returns a table or batch ``(id, attr, sends)`` with a row for each of them, in any order.
    ``sends`` is a list of structs ``(to, msg)``: none, one or many per node, ``to`` being the id
    of an incident node or null for all of them. ``message`` is the type of ``msg`` in DDL.

    It must give the same for the same nodes, since a lost task runs again; batches have at most
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, and how nodes are dealt to them is open.
    The rows it returns are shuffled once more than those of a :class:`Program`, to their buckets.
    """

    step: Callable[[int, pa.RecordBatch], pa.RecordBatch | pa.Table]
    message: str
    combiner: Combiner | str | Callable[[Column, Column], Column] | None = None


@dataclass
class _State:
    """Rows ``(id, attr, ...outbox)`` of one role and the sends of its last step.

    ``listed`` says that each row lists its sends in ``_sends``, as an :class:`ArrowProgram` does.
    """

    rows: DataFrame
    sends: list[Send] = field(default_factory=list)
    listed: bool = False


#: Numeric types, each of which holds the values of those before it.
_WIDTHS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _fits(new: T.DataType, kind: T.DataType) -> bool:
    """Whether every value of type ``new`` can be kept as ``kind``."""
    if isinstance(new, T.NullType) or new.simpleString() == kind.simpleString():
        return True
    if isinstance(new, T.StructType) and isinstance(kind, T.StructType):
        return new.names == kind.names and all(_fits(a.dataType, b.dataType) for a, b in zip(new, kind))
    if isinstance(new, T.ArrayType) and isinstance(kind, T.ArrayType):
        return _fits(new.elementType, kind.elementType)
    if isinstance(new, T.MapType) and isinstance(kind, T.MapType):
        return _fits(new.keyType, kind.keyType) and _fits(new.valueType, kind.valueType)
    if isinstance(kind, T.DecimalType):
        digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}.get(type(new))
        if isinstance(new, T.DecimalType):
            return new.scale <= kind.scale and new.precision - new.scale <= kind.precision - kind.scale
        return digits is not None and digits <= kind.precision - kind.scale
    kinds = [type(new), type(kind)]
    return all(x in _WIDTHS for x in kinds) and _WIDTHS.index(kinds[0]) <= _WIDTHS.index(kinds[1])


def _run_arrow(rows: DataFrame, ran: Column, program: ArrowProgram, superstep: int) -> _State:
    """Apply an Arrow program to rows ``(id, attr, msg)`` where ``ran`` holds; the others pass unchanged."""
    layered = "_layer" in rows.columns
    kind, step = rows.schema["attr"].dataType, program.step
    listed = T.DataType.fromDDL(f"array<struct<to:bigint,msg:{program.message}>>")
    fixed = [("id", T.LongType()), ("attr", kind), ("_ran", T.BooleanType()), ("_layer", T.IntegerType()), ("_sends", listed)]
    schema = T.StructType([T.StructField(*f) for f in fixed])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            given = pa.Table.from_batches([batch])
            idle = given.filter(pc.invert(given["_ran"])).select(["id", "attr", "_ran", "_layer"])
            parts = [idle.append_column("_sends", pa.nulls(idle.num_rows, target.field("_sends").type))]
            heard = given.filter(given["_ran"]).combine_chunks()
            for part in heard.select(["id", "attr", "msg"]).to_batches():
                found = step(superstep, part)
                found = pa.Table.from_batches([found]) if isinstance(found, pa.RecordBatch) else found
                place = pc.index_in(found["id"], value_set=heard["id"].combine_chunks())
                if found.num_rows != part.num_rows or place.null_count or len(pc.unique(place)) != part.num_rows:
                    raise ValueError("an Arrow program returns one row for each node of its batch")
                found = found.rename_columns(["_sends" if c == "sends" else c for c in found.column_names])
                own = heard.select(["_ran", "_layer"]).take(place)
                parts.append(found.append_column("_ran", own["_ran"]).append_column("_layer", own["_layer"]))
            for table in parts:
                yield from table.select(target.names).cast(target).to_batches()

    given = rows.select("id", "attr", "msg", ran.alias("_ran"), (F.col("_layer") if layered else F.lit(-1)).cast("int").alias("_layer"))
    done = given.mapInArrow(run, schema)
    return _State(done if layered else done.drop("_layer"), listed=True)


def _run(rows: DataFrame, ran: Column, program: Program | ArrowProgram, superstep: int) -> _State:
    """Apply a program to rows ``(id, attr, msg)`` where ``ran`` holds."""
    if isinstance(program, ArrowProgram):
        return _run_arrow(rows, ran, program, superstep)
    kind = rows.schema["attr"].dataType
    step = program.step(superstep, F.col("id"), F.col("attr"), F.col("msg"))
    attr = F.col("attr")
    if step.become is not None:
        new = rows.select(step.become.alias("new")).schema["new"].dataType
        if not _fits(new, kind):
            raise TypeError(
                f"a program turns an attribute of type {kind.simpleString()} into {new.simpleString()}; "
                "cast the attribute first or what it becomes"
            )
        same = new.simpleString() == kind.simpleString()
        become = step.become if same else step.become.cast(kind.simpleString())
        attr = F.when(ran, become).otherwise(attr)
    outbox = []
    for i, send in enumerate(step.sends):
        sent = ran if send.when is None else ran & F.coalesce(send.when, F.lit(False))
        outbox.append(sent.alias(f"_sent{i}"))
        if not callable(send.payload):
            outbox.append(F.when(sent, send.payload).alias(f"_out{i}"))
        if not isinstance(send.to, Everyone) and isinstance(send.to.ids, Column):
            outbox.append(F.when(sent, send.to.ids).alias(f"_to{i}"))
    if any(callable(send.payload) for send in step.sends):
        outbox.append(F.struct("attr", "msg").alias("_was"))
    rest = [c for c in rows.columns if c == "_layer"]
    state = rows.select("id", attr.alias("attr"), ran.alias("_ran"), *outbox, *rest)
    return _State(state, step.sends)


def _any_sent(state: _State) -> Column:
    sent = F.lit(False)
    if state.listed:
        return F.coalesce(F.size("_sends") > 0, sent)
    for i in range(len(state.sends)):
        sent = sent | F.col(f"_sent{i}")
    return sent


def _accepts(i: int, send: Send) -> Column:
    """Whether the link's destination is a recipient of send ``i``."""
    sent = F.col(f"_sent{i}")
    if isinstance(send.to, Everyone):
        return sent
    if isinstance(send.to.ids, DataFrame):
        listed = F.col(f"_listed{i}")
    elif isinstance(send.to.ids, Column):
        listed = F.array_contains(f"_to{i}", F.col("dst_id"))
    else:
        listed = F.col("dst_id").isin([int(x) for x in send.to.ids])
    return sent & (~listed if isinstance(send.to, AllExcept) else listed)


def _marked(linked: DataFrame, sends: list[Send]) -> DataFrame:
    """``_listed{i}`` for each send whose recipients are a frame: whether the link is in it."""
    ends = {"sender": "src_id", "receiver": "dst_id"}
    for i, send in enumerate(sends):
        if isinstance(send.to, Everyone) or not isinstance(send.to.ids, DataFrame):
            continue
        keys = [c for c in ends if c in send.to.ids.columns]
        if "receiver" not in keys:
            raise ValueError("a frame of recipients needs a column receiver")
        listed = send.to.ids.select(*[F.col(c).cast("bigint").alias(ends[c]) for c in keys]).dropna().distinct()
        linked = linked.join(listed.withColumn(f"_listed{i}", F.lit(True)), [ends[c] for c in keys], "left")
        linked = linked.withColumn(f"_listed{i}", F.coalesce(f"_listed{i}", F.lit(False)))
    return linked


def _for_receivers(sends: list[Send]) -> bool:
    """Whether all is one send to receivers that a frame names whoever sends: their messages
    can be combined first, so that no receiver's links have to meet in one place."""
    if len(sends) != 1 or isinstance(sends[0].to, Everyone) or not isinstance(sends[0].to.ids, DataFrame):
        return False
    return "receiver" in sends[0].to.ids.columns and "sender" not in sends[0].to.ids.columns


def _deliver(state: _State, routes, combiner, traffic: list | None = None) -> DataFrame:
    """Messages of ``state`` combined per destination: ``(dst_id, msg)``.

    ``traffic`` collects how many rows that takes on placed links, see :func:`compute`.
    """
    sends = state.sends
    if state.listed:
        senders = state.rows.where(_any_sent(state)).select(F.col("id").alias("src_id"), "_sends")
        linked = routes.join(senders)
        letter = linked.select(*linked.columns, F.explode("_sends").alias("letter"))
        letter = letter.where(F.coalesce(F.col("letter.to") == F.col("dst_id"), F.lit(True)))
        if traffic is not None:
            _count(letter, traffic)
        return _combined(letter.select("dst_id", "letter.msg", "copies"), combiner)
    if _for_receivers(sends):
        to = sends[0].to
        found = _deliver(_State(state.rows, [replace(sends[0], to=Everyone())]), routes, combiner, traffic)
        listed = to.ids.select(F.col("receiver").cast("bigint").alias("dst_id"))
        return found.join(listed, "dst_id", "left_anti" if isinstance(to, AllExcept) else "left_semi")
    senders = state.rows.where(_any_sent(state)).drop("attr", "_ran")
    linked = _marked(routes.join(senders.withColumnRenamed("id", "src_id")), sends)
    if "_was" in linked.columns:
        linked = linked.select("*", F.col("src_id").alias("id"), "_was.attr", "_was.msg")
    letters = [
        F.struct(
            _accepts(i, send).alias("keep"),
            (send.payload(F.col("dst_id")) if callable(send.payload) else F.col(f"_out{i}")).alias("msg"),
        )
        for i, send in enumerate(sends)
    ]
    if traffic is not None:
        _count(linked.where(F.exists(F.array(*letters), lambda x: x["keep"])), traffic)
    if len(letters) == 1:
        letter = linked.select("dst_id", "copies", letters[0].alias("letter"))
    else:
        letter = linked.select("dst_id", "copies", F.explode(F.array(*letters)).alias("letter"))
    return _combined(letter.where("letter.keep").select("dst_id", "letter.msg", "copies"), combiner)


def _count(linked: DataFrame, traffic: list) -> None:
    """Add a half step to ``traffic``: its copies of senders and its messages after combining within parts."""
    counts = linked.agg(F.count_distinct("part", "src_id"), F.count_distinct("part", "dst_id")).first()
    traffic.append((len(traffic), *counts))


def _combined(rows: DataFrame, combiner) -> DataFrame:
    if combiner is None:
        combiner = default_combiner(rows.schema["msg"].dataType)
    return resolve(combiner).merge(rows)


def _near(senders: _State, lane: Lane, combiner, nodes: NodeState) -> NearLane | None:
    """Links that lie with their receivers, if that ships fewer rows than combined messages would be.

    Only where what is sent is one binary to everyone, a sketch that is as large as many numbers; and
    not if some receivers have far more links than others, whose messages have to be combined in many places.
    """
    sends = senders.sends
    if senders.listed or isinstance(lane, PlacedLane) or len(sends) != 1 or not isinstance(sends[0].to, Everyone) or callable(sends[0].payload):
        return None
    kind = senders.rows.schema["_out0"].dataType
    if not isinstance(kind, T.BinaryType) or not isinstance(resolve(combiner or default_combiner(kind)), Aggregate):
        return None
    number, size = senders.rows.where("_sent0").agg(F.count("*"), F.sum(F.length("_out0"))).first()
    if not number or number > nodes.number:
        return None
    links = lane.links()
    total = links.count()
    parts = parts_for(links.sparkSession, total, number, size)
    if 2 * rows_shipped(parts, total, number) > total or hot_keys(links, "dst_id", total, parts) is not None:
        return None
    return NearLane(links, parts, nodes.parts)


def _half_step(
    senders: _State, lane: Lane, combiner, nodes: NodeState, program: Program, superstep: int, traffic: list | None
) -> tuple[_State, int, int]:
    """Deliver to ``nodes``, run their program on those that have a message, write their new state.

    Returns what they send, the number of nodes that had a message and of nodes that sent one.
    """
    near = _near(senders, lane, combiner, nodes)
    if near is not None:
        loop = nodes.base.sparkSession
        with ExitStack() as kept:
            kept.callback(near.release)
            for key, value in SETTINGS.items():
                kept.callback(loop.conf.set, key, loop.conf.get(key))
                loop.conf.set(key, value)
            rows = senders.rows.where("_sent0").select(F.col("id").alias("src_id"), F.col("_out0").alias("msg"))
            rows = near.join(rows).select(SLOT, "dst_id", "msg", "copies")
            combined = resolve(combiner or default_combiner(rows.schema["msg"].dataType)).merge(rows, SLOT)
            return _written(nodes.beside(combined, near), nodes, program, superstep, True)
    return _written(nodes.current(_deliver(senders, lane, combiner, traffic)), nodes, program, superstep)


def _written(heard: DataFrame, nodes: NodeState, program: Program, superstep: int, moved: bool = False) -> tuple[_State, int, int]:
    """Run ``program`` on ``heard`` and write the state; ``moved`` says that nodes do not lie in their buckets."""
    state = _run(heard, F.col("dst_id").isNotNull(), program, superstep)
    seen = Observation()
    counts = [F.count_if("_ran").alias("heard"), F.count_if(_any_sent(state)).alias("sent"), *nodes.counters()]
    rows = state.rows.observe(seen, *counts).drop("_layer")
    # what a Python function returns is not known to be partitioned
    written = nodes.push(rows.repartition(nodes.parts, "id") if state.listed or moved else rows)
    found = seen.get
    nodes.pushed(written, found["heard"], found)
    return _State(written, state.sends, state.listed), found["heard"], found["sent"]


def compute(
    graph: HyperGraph,
    max_iters: int | None,
    initial: Column,
    vertex_program: Program | ArrowProgram,
    hyperedge_program: Program | ArrowProgram,
    trace: list[int] | None = None,
    frontier: list[tuple[int, int, int]] | None = None,
    traffic: list[tuple[int, int, int]] | None = None,
) -> HyperGraph:
    """Run vertex and hyperedge programs in alternation.

    Superstep 0 runs the vertex program on every vertex with the message ``initial``.
    From then on a node runs only if it has a message; the others keep their attribute
    and send nothing. Each program runs at most ``max_iters`` times (``None``: until no
    messages flow); with 0 only the first vertex run happens. Messages the hyperedges
    send in the last superstep are not applied. ``trace`` collects the number of nodes
    with a message per half step, ``frontier`` (half step, nodes with a message, nodes that
    send). On a graph made by :meth:`~weft.model.HyperGraph.prepare` the incidences stay
    where they are; otherwise they are laid out for this one run.

    Incidences with a column ``part`` are laid out by it: senders are shipped to the parts
    and messages combined there first. ``traffic`` then collects (half step, copies of senders
    shipped, messages after combining within parts); it costs one more job per half step.
    """
    if traffic is not None and "part" not in graph.inc.columns:
        raise ValueError("traffic is counted on placed incidences; call assign_parts first")
    if max_iters == 0:
        start = graph.hv.withColumn("msg", initial)
        state = _run(start.select("id", "attr", "msg"), F.lit(True), vertex_program, 0)
        return graph.with_tables(hv=cut(state.rows.select("id", "attr")), he=graph.he)

    with ExitStack() as kept:
        layout = graph.layout
        if layout is None:
            layout = Layout.of(graph)
            kept.callback(layout.release)
        nodes = {}
        loop = loop_session(graph.inc.sparkSession, layout.parts)
        for role in ("hv", "he"):
            nodes[role] = NodeState(getattr(graph, role), layout.parts, loop)
            kept.callback(nodes[role].release)
        first: list[_State] = []

        def begin(rows: DataFrame) -> DataFrame:
            first.append(_run(rows.withColumn("msg", initial), F.lit(True), vertex_program, 0))
            return first[0].rows

        if isinstance(vertex_program, ArrowProgram):  # written, so that it does not run again whenever the rows are read
            rows = _run(nodes["hv"].base.withColumn("msg", initial), F.lit(True), vertex_program, 0).rows
            state = _State(nodes["hv"].rewrite(rows), listed=True)
        else:
            nodes["hv"].replace(begin)
            state = first[0]
        program = {"hv": vertex_program, "he": hyperedge_program}
        superstep, half, sender, receiver = 0, 0, "hv", "he"
        while state.sends or state.listed:
            state, heard, sent = _half_step(
                state, layout.lanes[receiver], program[sender].combiner, nodes[receiver], program[receiver], superstep, traffic
            )
            if trace is not None:
                trace.append(heard)
            if frontier is not None:
                frontier.append((half, heard, sent))
            half += 1
            superstep += receiver == "he"
            if sent == 0 or superstep == max_iters:
                break
            sender, receiver = receiver, sender
        done = {role: nodes[role].finish() for role in ("hv", "he")}
    return graph.with_tables(**done)
