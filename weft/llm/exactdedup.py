"""Exact duplicates: copies combine within each task, then under salts, then globally.

Grouping columns are always a digest *and* the text, so that at each of the three stages two
rows combine only if their whole texts are equal: within a task before the shuffle, in the
salted groups after it, and where the winners of several salts meet. Only digests of very
many rows are salted; there are at most ``HOT_GROUPS`` of them. A group of copies therefore
sends one row per task and salt, however many copies it has.

Documents learn their group by digest. Digests under which different texts are found are
looked up by text, so the result does not depend on the digest being free of collisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import forget, kept

HOT_GROUPS = 1000  # a salted digest has more than this share (1 / HOT_GROUPS) of all rows
HOT_ROWS = 1000  # and more rows than this
SALTS = 64


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    digest_bytes: int = 32,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, sha)``, one row per row of ``docs``.

    Rows are copies if their texts are equal after ``normalise`` (by default as they are);
    a null text counts as empty. The largest id of a group stays; null ids are smaller than
    all others. Of rows that share text and largest id, exactly one is ``kept``. ``sha`` is
    the SHA-256 of the text (BINARY), of which the first ``digest_bytes`` bytes are the key
    of the shuffles. Other columns are ignored, and an empty table gives an empty one.
    """
    text = F.col(text_col).cast("string")
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    key = F.substring("sha", 1, digest_bytes).alias("key")
    members = kept(rows.select("doc_id", "sha"), "members")

    total = members.count()
    hot = members.groupBy(key).count().where(F.col("count") > max(hot_rows, total // HOT_GROUPS)).select("key")
    hot = kept(hot.withColumn("hot", F.lit(True)), "hot")  # HOT_GROUPS rows at most
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(-1)
    salted = rows.select(key, "doc_id", "text").join(F.broadcast(hot), "key", "left").select("key", "doc_id", "text", salt.alias("salt"))
    winners = salted.groupBy("key", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
    # only what has to meet again takes its text along
    winners = kept(winners.select("key", F.when(F.col("salt") >= 0, F.col("text")).alias("text"), "keep_id", "size"), "winners")
    settled = winners.where("text IS NULL").select("key", "keep_id", "size")
    met = winners.where("text IS NOT NULL").groupBy("key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    groups = settled.union(met.select("key", "keep_id", "size")).withColumn("group", F.monotonically_increasing_id())
    groups = kept(groups, "groups")

    clashes = kept(groups.groupBy("key").count().where("count > 1").select("key"), "clashes")
    columns = ["doc_id", "keep_id", F.col("size").alias("group_size"), "sha", "group"]
    found = members.withColumn("key", key).join(groups, "key")
    if clashes.isEmpty():
        found = found.select(*columns)
    else:
        alike = rows.withColumn("key", key).join(clashes, "key", "left_semi")
        texts = alike.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
        texts = kept(texts.withColumn("group", -1 - F.monotonically_increasing_id()), "texts")
        found = found.join(clashes, "key", "left_anti").select(*columns)
        found = found.union(alike.join(texts, ["key", "text"]).select(*columns))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    found = kept(found.select("*", first.alias("kept"), F.monotonically_increasing_id().alias("row")), "found")
    seen = found.where("kept").agg(F.count("*"), F.count_distinct("group")).first()
    if seen[0] > seen[1]:  # rows repeat text and id
        one = found.where("kept").groupBy("group").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("_one"))
        found = found.join(one, "row", "left").withColumn("kept", F.coalesce("_one", F.lit(False)))
    forget(members, hot, winners, groups, clashes)
    return found.select("doc_id", "keep_id", "group_size", "kept", "sha")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with the one row of each group of equal texts that has the largest id.

    All columns stay. Of rows that share text and id, one stays.
    """
    text = F.col(text_col).cast("string")
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    staying = duplicate_groups(docs, id_col, text_col, normalise).where("kept").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"))
    rows = docs.join(staying, docs[id_col].eqNullSafe(staying["_id"]) & (F.unhex(F.sha2(text, 256)) == staying["_sha"]))
    return rows.dropDuplicates(["_id", "_sha"]).select(*(docs[c] for c in docs.columns))
