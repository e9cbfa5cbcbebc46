"""Connected components by contraction, in a number of jobs that grows with the logarithm of their size.

A round hooks every node to its largest neighbour, follows these pointers up until each tree
has one root, and goes on with the links between roots. No two neighbours can both be the
largest around, so a round at least halves the nodes that are left, and pointers are followed
by squaring, so a chain of n nodes takes about log4(n) jobs where flooding takes n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.session import forget, kept


def _unordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _followed(parents: DataFrame, by: DataFrame) -> DataFrame:
    """``parents(id, root)`` with each root replaced by its own root in ``by``, where it has one."""
    steps = by.select(F.col("id").alias("_at"), F.col("root").alias("_root"))
    found = parents.join(steps, F.col("root") == F.col("_at"), "left")
    rest = [c for c in parents.columns if c not in ("id", "root")]
    return found.select("id", F.coalesce("_root", "root").alias("root"), *rest)


def _stars(parents: DataFrame, trace: list[str]) -> DataFrame:
    """Follow pointers of a written table until every root is its own; four links up a job."""
    while True:
        seen = Observation()
        further = parents.withColumn("was", F.col("root"))
        for _ in range(3):
            further = _followed(further, parents)
        reached = kept(further.observe(seen, F.count_if(F.col("root") != F.col("was")).alias("moved")).select("id", "root"), "roots")
        forget(parents)
        parents = reached
        trace.append("jump")
        if seen.get["moved"] == 0:
            return parents


def component_roots(links: DataFrame, trace: list[str] | None = None) -> DataFrame:
    """``(id, root)`` for every node of ``links(a, b)`` (BIGINT) that has a neighbour, root the
    largest node of its component.

    Repeated links and links of a node to itself do not matter. Only the result stays in the
    checkpoint folder, as a table of :func:`weft.session.kept` that the caller may forget. A node with very many links is a hot key of a join against one row per
    node, which adaptive execution splits. ``trace`` collects the kind of each job.
    """
    trace = [] if trace is None else trace
    left = kept(_unordered(links), "links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        tops = both.groupBy(F.col("a").alias("id")).agg(F.max("b").alias("top"))
        hooked = kept(tops.select("id", F.greatest("id", "top").alias("root")), "roots")
        trace.append("hook")
        rounds.append(_stars(hooked, trace))
        ends = {}
        for end in ("a", "b"):
            ends[end] = rounds[-1].select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
        rest = left.join(ends["a"], "a").join(ends["b"], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        contracted = kept(_unordered(rest), "links")
        trace.append("contract")
        forget(left)
        left = contracted
    forget(left)
    if not rounds:
        return links.sparkSession.createDataFrame([], "id bigint, root bigint")
    while len(rounds) > 1:  # the last rounds are the smallest
        last, before = rounds.pop(), rounds.pop()
        rounds.append(kept(_followed(before, last), "roots"))
        forget(last, before)
    return rounds[0]
