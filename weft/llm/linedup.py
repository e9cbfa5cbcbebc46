"""Site-relative line frequency: lines on too large a share of a host's pages are boilerplate.

A host's boilerplate lines are few by arithmetic: each is on more than ``ratio`` of its
pages, so there are at most (distinct lines of a mean page) / ratio. They travel as one
small row per host, and texts are filtered where they are: no text is taken apart and
put together again over a shuffle. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept

RATIO = 0.08
MIN_PAGES = 3
BROADCAST_LINES = 200_000  # about 11 MB of digests; more go through a join that adaptive execution splits


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_vote: bool = True
) -> DataFrame:
    """``(host, digest, pages, total)``: lines on at least ``min_pages`` and more than ``ratio`` of a host's pages.

    Unless ``copies_vote``, pages of a host with equal texts count as one, in ``pages`` and in ``total``.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    number = F.count("*") if copies_vote else F.count_distinct("page")
    pages = pages if copies_vote else pages.withColumn("page", F.xxhash64("text"))
    own = [] if copies_vote else ["page"]
    totals = pages.groupBy("host").agg(number.alias("total"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), F.md5))
    counts = (
        pages.select("host", *own, F.explode(digests).alias("digest"))
        .groupBy("host", "digest")
        .agg(number.alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    both = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return both.where(F.col("pages") / F.col("total") > ratio).select("c.host", "digest", "pages", "total")


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_vote: bool = True
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``; all rows and columns stay.

    A page is one row (one text, unless ``copies_vote``); a line repeated within it counts once, and all its copies go. Lines
    are compared whole; blank ones are never boilerplate. Null texts stay null and empty
    ones empty, both count as pages. Null is a host like any other. A page of nothing but
    boilerplate is left with an empty text. Hosts of fewer than ``min_pages`` pages lose nothing.
    """
    found = boilerplate(docs, host_col, text_col, ratio, min_pages, copies_vote)
    lists = kept(found.groupBy("host").agg(F.collect_list("digest").alias("digests")), "boilerplate")
    number = lists.agg(F.sum(F.size("digests"))).first()[0] or 0
    bad = lists.select(F.col("host").alias("_line_host"), F.col("digests").alias("_line_digests"))
    if number <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    joined = docs.join(bad, docs[host_col].eqNullSafe(bad["_line_host"]), "left")
    clean = F.array_join(
        F.filter(_lines(docs[text_col]), lambda x: ~F.array_contains(bad["_line_digests"], F.md5(x)) | (F.trim(x) == "")), "\n"
    )
    text = F.when(bad["_line_digests"].isNull(), docs[text_col]).otherwise(clean)
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))
