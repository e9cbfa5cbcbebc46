"""Joins and aggregations that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import hot_rows, shuffle_partitions

FAN, SALT = "_fan", "_salt"


def hot_limit(spark: SparkSession, total: int, parts: int | None = None) -> int:
    """Rows above which a key is hot: twice the mean of ``parts`` (the session's) partitions, or the session's floor.

    Fewer than ``parts / 2`` keys can lie above it, whatever the data.
    """
    return max(hot_rows(spark), -(-2 * total // (parts or shuffle_partitions(spark))))


def hot_keys(rows: DataFrame, key: str, total: int, parts: int | None = None) -> DataFrame | None:
    """``(key, _fan)`` for the hot keys of ``rows``, or ``None`` if there are none.

    ``_fan`` is the number of pieces the key is split into. The result has fewer than
    ``parts / 2`` rows (see :func:`hot_limit`), so it is safe to fetch and to broadcast.
    """
    spark = rows.sparkSession
    limit = hot_limit(spark, total, parts)
    if total <= limit:
        return None
    hot = (
        rows.groupBy(key)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > limit)
        .select(key, F.ceil(F.col("n") / limit).cast("int").alias(FAN))
    )
    found = hot.collect()
    return F.broadcast(spark.createDataFrame(found, hot.schema)) if found else None


def _fan() -> Column:
    return F.coalesce(F.col(FAN), F.lit(1))


def split_rows(rows: DataFrame, key: str, by: list[str], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: 0 for ordinary keys, spread over ``0.._fan-1`` by a hash of ``by`` for hot ones."""
    salt = F.pmod(F.xxhash64(*by), _fan()).cast("int")
    return rows.join(hot, key, "left").withColumn(SALT, salt).drop(FAN)


def copy_rows(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat the (unique) row of every hot key once per piece, as ``_salt``."""
    salts = F.explode(F.sequence(F.lit(0), _fan() - 1))
    return rows.join(hot, key, "left").withColumn(SALT, salts).drop(FAN)


def apart(rows: DataFrame) -> DataFrame:
    """Separate an aggregated node table from the join that follows it.

    Adaptive execution splits a skewed join partition, even one made of copies of a
    single row, but only if both join inputs come straight from a shuffle. An
    aggregate keyed like the join would share its shuffle and prevent that; one
    rebalancing shuffle of the (node-sized) table keeps the two apart.
    """
    return rows.hint("rebalance")
