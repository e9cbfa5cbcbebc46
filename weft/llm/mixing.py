"""Mixing sources by temperature.

Source weights are token shares to the power ``tau``: 1 keeps the shares, 0 makes all
sources equal. ``tau`` is bisected to the flattest mix within the given limits. The mix is
then realised: each source is a stream of epochs, each epoch a permutation of its
documents' blocks and of the documents in a block, cut at the source's token budget.

Blocks are dealt by hash and hold about ``BLOCK_DOCS`` documents however large a source
is. Places come from sums per block, added up over the few block rows, then from a window
within each block, so no task needs a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import kept

STEPS = 1 << 20  # tau is a multiple of 1 / STEPS
MAX_REPEATS = 2.0
BLOCK_DOCS = 1000
STEP_TOKENS = 1_000_000
MICRO = 1_000_000  # repeats are fixed to six digits
HASH_RANGE = 1 << 32


def word_count(text: Column) -> Column:
    """Words of a text and one for its end; 1 for null."""
    return (F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")) + 1).cast("bigint")


def source_totals(docs: DataFrame) -> DataFrame:
    """``(source, docs, tokens)`` of ``docs(source, tokens)``."""
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def exponent(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> int:
    """The smallest ``tau`` (in 1/STEPS) that keeps both limits.

    ``max_repeats``: how often the most repeated source may be passed per pass of the least
    repeated one. ``target_entropy``: of the weights, as a share of log(number of sources).
    Both only get smaller as ``tau`` grows, so it is bisected, four halvings per job; a job
    reads one row per source and returns 15 rows.
    """
    whole = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("low"), F.max("tokens").alias("high")).first()
    if not whole.n:
        return STEPS

    def within(candidates: list[int]) -> list[bool]:
        entropy = {}
        if target_entropy is not None and whole.n > 1:
            tau = F.explode(F.array(*map(F.lit, candidates))).alias("i")
            share = totals.select(F.log(F.col("tokens") / F.lit(whole.t)).alias("p"), tau).withColumn("w", F.exp(F.col("p") * F.col("i") / STEPS))
            for row in share.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("p")).alias("wp")).collect():
                entropy[row.i] = (math.log(row.z) - row.i / STEPS * row.wp / row.z) / math.log(whole.n)
        repeats = {i: (whole.high / whole.low) ** (1 - i / STEPS) for i in candidates}
        return [
            (max_repeats is None or repeats[i] <= max_repeats) and entropy.get(i, 0.0) <= (1.0 if target_entropy is None else target_entropy)
            for i in candidates
        ]

    low, high = 0, STEPS  # STEPS is taken as within: nothing is more like the data
    while low < high:
        inner = sorted({low + (high - low) * k // 16 for k in range(16)})
        good = within(inner)
        if any(good):
            first = good.index(True)
            high, low = inner[first], (inner[first - 1] + 1 if first else inner[first])
        else:
            low = inner[-1] + 1
    return low


def budgets(totals: DataFrame, tau: int, total_tokens: int | None = None) -> DataFrame:
    """``totals`` plus ``budget`` in tokens.

    By default every source is passed at least once, the one with the largest share
    exactly once, so no document is lost. ``total_tokens`` gives the size of the whole mix
    instead; sources with less than one pass are then cut off.
    """
    high = totals.agg(F.max("tokens")).first()[0] or 1
    weight = F.pow(F.col("tokens") / F.lit(high), F.lit(tau / STEPS))
    if total_tokens is None:
        repeats = weight / (F.col("tokens") / F.lit(high))
    else:
        norm = totals.agg(F.sum(weight)).first()[0] or 1.0
        repeats = weight / F.lit(norm) * F.lit(total_tokens) / F.col("tokens")
    micro = F.greatest(F.round(repeats * MICRO).cast("bigint"), F.lit(MICRO if total_tokens is None else 0))
    product = f"(tokens div {MICRO}) * _micro + ((tokens % {MICRO}) * _micro) div {MICRO}"  # no overflow before the result's own
    return totals.withColumn("_micro", micro).withColumn("budget", F.expr(product)).drop("_micro")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    tokens: Column | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
    total_tokens: int | None = None,
    block_docs: int = BLOCK_DOCS,
    step_tokens: int = STEP_TOKENS,
    key: Column | None = None,
) -> DataFrame:
    """One row per occurrence of a document in the mix: ``doc_id, source, epoch, tokens, position, step``.

    ``position`` is the token at which it starts in its source's stream, ``step`` the
    training step (of about ``step_tokens`` over all sources) that it falls into; every
    step holds each source by its weight. A document is taken if it starts within the
    budget. Null is a source like any other. ``tokens`` (default: words of ``text`` and
    one) is counted as at least 1. Rows that repeat an id are documents of their own, in
    an order among themselves that follows their tokens, then ``key``; a ``key`` (BIGINT)
    is returned as ``_key``. An empty table gives an empty one.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.greatest(F.coalesce(tokens, F.lit(1)).cast("bigint"), F.lit(1)).alias("tokens"),
        *([] if key is None else [key.alias("_key")]),
    )
    return _streams(kept(rows, "mix"), max_repeats, target_entropy, total_tokens, block_docs, step_tokens)


def _place(epoch: Column, doc: Column) -> Column:
    """32-bit place of a document in an epoch's permutation."""
    text = F.md5(F.concat(epoch.cast("string"), F.lit(":"), F.coalesce(doc.cast("string"), F.lit("null"))))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")


def _streams(rows: DataFrame, max_repeats, target_entropy, total_tokens, block_docs, step_tokens) -> DataFrame:
    keys = [c for c in rows.columns if c == "_key"]
    totals = kept(source_totals(rows), "sources")
    plan = budgets(totals, exponent(totals, max_repeats, target_entropy), total_tokens)
    plan = kept(plan.withColumn("_source", F.struct("source")).drop("source"), "budgets")
    steps = max(1, (plan.agg(F.sum("budget")).first()[0] or 0) // step_tokens)
    each = rows.withColumn("_source", F.struct("source")).drop("source")  # structs compare nulls as equal keys
    each = each.join(plan.withColumnRenamed("tokens", "total"), each["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])
    each = each.select("*", F.explode(F.expr("sequence(0, (budget - 1) div total)")).alias("epoch")).where("budget > 0")
    each = each.withColumn("place", _place(F.col("epoch"), F.col("doc_id")))
    each = each.withColumn("block", F.expr(f"place * ((docs + {block_docs - 1}) div {block_docs}) div {HASH_RANGE}"))
    by_block = Window.partitionBy("_source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        each.groupBy("_source", "epoch", "block")
        .agg(F.sum("tokens").alias("sum"))
        .select("_source", "epoch", "block", F.coalesce(F.sum("sum").over(by_block), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("_source", "epoch", "block").orderBy("place", "doc_id", "tokens", *keys).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    each = each.join(starts, ["_source", "epoch", "block"])
    each = each.withColumn("position", F.col("epoch") * F.col("total") + F.col("before") + F.col("within")).where("position < budget")
    step = F.floor(F.col("position") / F.col("budget") * F.lit(steps)).cast("bigint").alias("step")
    return each.select("doc_id", F.col("_source.source").alias("source"), F.col("epoch").cast("int").alias("epoch"), "tokens", "position", step, *keys)
