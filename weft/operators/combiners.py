"""How several messages for one node become one.

A combiner receives rows ``(dst_id, msg, copies)``, where ``copies`` says how many times
the same message arrived, and returns one row ``(dst_id, msg)`` per destination. The
combining is associative and commutative, so Spark pre-aggregates before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import mode_struct, repeat_fold
from weft.session import cut, discard, shuffle_partitions

#: Default number of values folded in one group by :class:`Fold`.
FOLD_ROWS = 10_000

#: Values that a task of :func:`fold_by_key` gathers, of all its keys.
TASK_ROWS = 500_000


class Combiner:
    def merge(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


class Aggregate(Combiner):
    """A built-in aggregate: ``expression(msg, copies)`` returns an aggregate Column."""

    def __init__(self, expression: Callable[[Column, Column], Column]):
        self.expression = expression

    def merge(self, rows: DataFrame, *keys: str) -> DataFrame:
        """``keys`` that follow from the destination come along, for rows that are partitioned by them."""
        msg = self.expression(F.col("msg"), F.col("copies"))
        return rows.groupBy(*keys, "dst_id").agg(msg.alias("msg"))


def total() -> Aggregate:
    return Aggregate(lambda msg, copies: F.sum(msg * copies))


def largest() -> Aggregate:
    return Aggregate(lambda msg, copies: F.max(msg))


def smallest() -> Aggregate:
    return Aggregate(lambda msg, copies: F.min(msg))


def sketch_union() -> Aggregate:
    """Union of HLL sketches (``hll_sketch_agg`` binaries)."""
    return Aggregate(lambda msg, copies: F.hll_union_agg(msg))


def fields(**parts: Aggregate) -> Aggregate:
    """A struct message, combined field by field."""
    return Aggregate(
        lambda msg, copies: F.struct(
            *[part.expression(msg[name], copies).alias(name) for name, part in parts.items()]
        )
    )


class Mode(Combiner):
    """The most frequent message; of equally frequent ones the largest.

    Counts per (destination, message) first, so no histogram is ever held in one row.
    """

    def merge(self, rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("dst_id", "msg").agg(F.sum("copies").alias("n"))
        best = mode_struct(F.col("msg"), F.col("n"))
        return counts.groupBy("dst_id").agg(best.alias("msg"))


class _Collecting(Combiner):
    """Base of combiners whose result itself is a collection.

    Such a message is as large as everything it merges, and Spark keeps a row in one
    piece. A caller that wants a bound gives ``max_entries``: sizes are then added up
    first, and a message beyond it raises; nothing is dropped or shortened. Programs that
    only need a sum, count, extreme or mode over the entries should send a struct or use
    :class:`Mode`.
    """

    def __init__(self, max_entries: int | None = None):
        self.max_entries = max_entries

    def check(self, sizes: DataFrame) -> None:
        if self.max_entries is None:
            return
        most = sizes.groupBy("dst_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if most is not None and most > self.max_entries:
            raise ValueError(f"a combined message has {most} entries, limit {self.max_entries}")


class SumByKey(_Collecting):
    """Map messages: values of equal keys are combined, by ``values`` or, without it, added.

    An empty map is a message too: its destination gets an empty map if nothing else came.
    Null messages count as empty.
    """

    def __init__(self, max_entries: int | None = None, values: Combiner | None = None):
        super().__init__(max_entries)
        self.values = values

    def merge(self, rows: DataFrame) -> DataFrame:
        # explode_outer leaves a row with a null key, which no map has, for an empty map
        entries = rows.select("dst_id", "copies", F.explode_outer("msg").alias("k", "v"))
        if self.values is None:
            entries = entries.groupBy("dst_id", "k").agg(F.sum(F.col("v") * F.col("copies")).alias("v"))
        else:
            single = entries.select(F.struct("dst_id", "k").alias("dst_id"), F.col("v").alias("msg"), "copies")
            merged = self.values.merge(single.where("dst_id.k is not null"))
            merged = merged.select("dst_id.*", F.col("msg").alias("v"))
            empty = F.lit(None).cast(merged.schema["v"].dataType).alias("v")
            entries = merged.unionByName(single.where("dst_id.k is null").select("dst_id.*", empty))
        if self.max_entries is not None:
            entries = cut(entries)
            self.check(entries.select("dst_id", F.when(F.col("k").isNotNull(), 1).otherwise(0).alias("n")))
        pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
        if self.values is None:
            pairs = F.array_sort(pairs)  # nested maps cannot be compared
        return entries.groupBy("dst_id").agg(F.map_from_entries(pairs).alias("msg"))


class Concatenate(_Collecting):
    """Array messages: concatenation, in sorted order so that the result is reproducible."""

    def merge(self, rows: DataFrame) -> DataFrame:
        if self.max_entries is not None:
            rows = cut(rows)
        self.check(rows.select("dst_id", (F.size("msg") * F.col("copies")).alias("n")))
        repeated = F.flatten(F.array_repeat("msg", F.col("copies").cast("int")))
        return rows.groupBy("dst_id").agg(
            F.array_sort(F.flatten(F.collect_list(repeated))).alias("msg")
        )


class ByField(Combiner):
    """A struct message, combined field by field with combiners of any kind, joined by destination.

    Fields combined by built-in aggregates share one pass; :func:`fields` is enough where all are.
    """

    def __init__(self, **parts: Combiner):
        self.parts = parts

    def merge(self, rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        simple = {name: part for name, part in self.parts.items() if isinstance(part, Aggregate)}
        merged = fields(**simple).merge(rows) if simple else rows.select("dst_id").distinct().withColumn("msg", F.struct())
        for name, part in self.parts.items():
            if name not in simple:
                one = part.merge(rows.select("dst_id", F.col("msg")[name].alias("msg"), "copies"))
                merged = merged.join(one.withColumnRenamed("msg", f"_{name}"), "dst_id")
        found = [(F.col("msg")[name] if name in simple else F.col(f"_{name}")).alias(name) for name in self.parts]
        return merged.select("dst_id", F.struct(*found).alias("msg"))


class Fold(Combiner):
    """A binary function on Columns; must be associative and commutative."""

    def __init__(self, f: Callable[[Column, Column], Column], group_rows: int = FOLD_ROWS):
        self.f, self.group_rows = f, group_rows

    def merge(self, rows: DataFrame) -> DataFrame:
        return fold_by_key(rows, ["dst_id"], "msg", self.f, self.group_rows)


def fold_by_key(
    rows: DataFrame,
    keys: list[str],
    value: str,
    f: Callable[[Column, Column], Column],
    group_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Fold ``value`` (``copies`` times each) per key with an arbitrary binary function.

    Equal values are merged into one with a multiplicity, which :func:`repeat_fold`
    applies in logarithmic time. While some key still has more than ``group_rows``
    values, all keys are folded within hash slices of about half that many; so no
    group that is gathered grows with the data.
    """
    slices_done, before = 0, None
    while True:
        merged = rows.groupBy(*keys, value).agg(F.sum("copies").alias("copies"))
        written = Observation()
        merged = cut(merged.observe(written, F.count("*").alias("n")))
        discard(before)
        before = merged
        # a checkpoint forgets how it is partitioned; the keys of a partition are counted and gathered in its task
        tasks = max(shuffle_partitions(merged.sparkSession), -(-(written.get["n"] or 0) // TASK_ROWS))
        most = merged.select(*keys).repartition(tasks, *keys).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        merged = merged.repartition(tasks, *keys)
        # at most half as many slices as values, so that every round at least halves them
        slices = 1 if most <= group_rows else max(1, min(-(-2 * most // group_rows), most // 2))
        folded = merged.select(
            *keys,
            F.pmod(F.xxhash64(value, F.lit(slices_done)), F.lit(slices)).alias("slice"),
            repeat_fold(F.col(value), F.col("copies"), f).alias(value),
        )
        values = F.collect_list(value)
        rest = F.slice(values, F.lit(2), F.size(values))
        folded = folded.groupBy(*keys, "slice").agg(
            F.reduce(rest, F.element_at(values, 1), f).alias(value)
        )
        if slices == 1:
            return folded.drop("slice")
        rows = folded.select(*keys, value, F.lit(1).cast("bigint").alias("copies"))
        slices_done += 1


def default_combiner(kind: T.DataType) -> Combiner:
    """The combiner a message type implies: numbers add, sketches unite, structs combine by
    field and maps by key (whatever they hold), arrays concatenate."""
    if isinstance(kind, T.NumericType):
        return total()
    if isinstance(kind, T.StructType):
        parts = {field.name: default_combiner(field.dataType) for field in kind.fields}
        if all(isinstance(part, Aggregate) for part in parts.values()):
            return fields(**parts)
        return ByField(**parts)
    if isinstance(kind, T.MapType):
        return SumByKey(values=None if isinstance(kind.valueType, T.NumericType) else default_combiner(kind.valueType))
    if isinstance(kind, T.BinaryType):
        return sketch_union()
    if isinstance(kind, T.ArrayType):
        return Concatenate()
    raise TypeError(f"no default combiner for messages of type {kind.simpleString()}")


NAMED = {"sum": total, "max": largest, "min": smallest, "mode": Mode, "sketch": sketch_union, "concat": Concatenate}


def resolve(combiner: Combiner | str | Callable[[Column, Column], Column]) -> Combiner:
    """A combiner object, a name (``sum max min mode sketch concat``), or a binary function to fold with."""
    if isinstance(combiner, Combiner):
        return combiner
    if isinstance(combiner, str):
        return NAMED[combiner]()
    return Fold(combiner)
