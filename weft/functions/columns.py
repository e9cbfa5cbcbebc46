"""Small expressions shared by operators and algorithms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def infinity() -> Column:
    return F.lit(float("inf"))


def divide(top: Column, bottom: Column) -> Column:
    """Floating division where ``x / 0`` is infinite (``NaN`` for ``0 / 0``) instead of an error."""
    return F.when(bottom != 0, top / bottom).otherwise(top.cast("double") * infinity())


def entropy_bits(value: Column) -> Column:
    """Aggregate: Shannon entropy in bits of the values taken as shares of their sum.

    One pass: with S = sum(x), H = log2(S) - sum(x log2 x) / S. A zero share adds
    nothing (0 log 0 = 0).
    """
    total = F.sum(value)
    weighted = F.sum(F.when(value > 0, value * F.log2(value)).otherwise(F.lit(0.0)))
    return F.log2(total) - weighted / total


def mode_struct(label: Column, count: Column) -> Column:
    """Aggregate over (label, count) rows: the label of highest count, ties to the largest label."""
    return F.max(F.struct(count.alias("n"), label.alias("label")))["label"]


def repeat_fold(value: Column, times: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(value, f(value, ...))`` with ``times`` copies of ``value``, in log2(times) steps.

    Relies on ``f`` being associative: the copies are combined by repeated squaring.
    """
    places = F.sequence(F.lit(0), F.length(F.bin(times)) - 1)
    start = F.struct(value.alias("power"), value.alias("acc"), F.lit(False).alias("any"))

    def step(state: Column, place: Column) -> Column:
        power = F.when(place == 0, state["power"]).otherwise(f(state["power"], state["power"]))
        taken = F.get(F.reverse(F.split(F.bin(times), "")), place) == "1"
        joined = F.when(state["any"], f(state["acc"], power)).otherwise(power)
        return F.struct(
            power.alias("power"),
            F.when(taken, joined).otherwise(state["acc"]).alias("acc"),
            (state["any"] | taken).alias("any"),
        )

    return F.when(times == 1, value).otherwise(
        F.aggregate(places, start, step, lambda state: state["acc"])
    )
