"""Documents to training sequences: five stages, each of which takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import linedup, mixing, packing, quality, simhash
from weft.llm.common import kept, table
from weft.llm.queries import MIX, TOKENIZERS

ORACLE_SQL = None  # no SQL for a trained classifier; tests compare each stage with a plain version


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` of ``docs``."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are on too many different pages of their source.

    Copies of a page are one vote: this stage runs before copies are removed, and a page's
    own copies would otherwise empty it.
    """
    clean = linedup.drop_boilerplate(docs, copies_vote=False)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates.

    A group is a component of linked fingerprints, whatever its ids: rows of one id whose texts
    are not linked are different documents, and each group keeps one. The smallest id stays,
    null after all others; of rows that share it, the one with the smallest hash of its text.
    """
    groups = simhash.near_duplicates(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    first = groups.groupBy("root").agg(least).select(F.col("least.doc_id").alias("_first"), F.col("least.text_hash").alias("_hash"))
    first = kept(first, "first")
    same = docs["doc_id"].eqNullSafe(first["_first"]) & (F.xxhash64(docs["text"]) == first["_hash"])
    found = kept(docs.join(first, same, "left_semi"), "found")
    if found.count() == first.count():
        return found
    return found.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).select(*found.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    key = F.xxhash64(*docs.columns)  # rows that share id and key are equal, and any of them stands for all
    taken = mixing.mix(docs, **MIX, key=key).groupBy("doc_id", "_key").agg(F.count("*").alias("_times"), F.count_if(F.col("epoch") == 0).alias("_rows"))
    taken = kept(taken, "taken")
    repeats = taken.where("_rows > 1").limit(1).count()
    taken = taken.select(F.col("doc_id").alias("_taken"), "_key", F.sequence(F.lit(1), F.col("_times")).alias("_copies"))
    single = docs.dropDuplicates() if repeats else docs
    key = F.xxhash64(*(single[c] for c in docs.columns))
    joined = single.join(taken, single["doc_id"].eqNullSafe(taken["_taken"]) & (key == taken["_key"]))
    docs = single
    return joined.select(*(docs[c] for c in docs.columns), F.explode(taken["_copies"]).alias("_copy")).select(*(F.col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; what the mix repeats is never twice in one."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json", copies_apart=True)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("SimHash near-dedup", one_of_each),
    ("mixing", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
