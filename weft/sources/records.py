"""JSON-lines records ``["title", "year", ["author", ...]]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import HyperGraph
from weft.session import kept
from weft.sources.groups import from_groups

# Fixed value: what a whole number in the year field looks like.
YEAR_PATTERN = "^[+-]?[0-9]+$"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _classified(lines: DataFrame) -> DataFrame:
    """Lines with their JSON parts and ``_form``: ``record``, ``misshapen`` or ``unparsable``.

    The parts come out of a generator of one row. A later filter cannot move below it,
    which would parse the line anew for every condition.
    """
    parts = F.try_variant_get("_json", "$", "array<variant>").alias("_parts")
    parsed = F.struct(parts, F.col("_json").isNotNull().alias("_is_json"))
    read = lines.select("*", F.try_parse_json("value").alias("_json")).select(
        *lines.columns, F.inline(F.array(parsed))
    )
    title, year, people = (F.get("_parts", i) for i in range(3))
    read = read.select(
        "*",
        title.alias("_title"),
        year.alias("_year"),
        F.try_variant_get(people, "$", "array<variant>").alias("_people"),
    )
    shaped = (
        (F.coalesce(F.size("_parts"), F.lit(0)) == 3)
        & _is(F.col("_title"), "STRING")
        & _is(F.col("_year"), "STRING")
        & F.col("_people").isNotNull()
    )
    form = (
        F.when(~F.col("_is_json"), "unparsable").when(shaped, "record").otherwise("misshapen")
    )
    return read.withColumn("_form", form)


def parse_records(lines: DataFrame, since: int = 0, strict: bool = False) -> DataFrame:
    """``lines(value STRING, ...)`` to ``(title, year INT, authors ARRAY<STRING>, ...)``.

    Lines that are not JSON and years that are no whole numbers are dropped, as are
    years before ``since``. Authors that are not strings are skipped, repeated ones
    count once. JSON of another shape is dropped too, or fails the job if ``strict``.
    """
    read = _classified(lines)
    record = F.col("_form") == "record"
    if strict:
        message = F.concat(F.lit("not a record: "), F.col("value"))
        wrong = F.col("_form") == "misshapen"
        record = F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(record)
    names = F.filter("_people", lambda person: _is(person, "STRING"))
    year = F.variant_get("_year", "$", "string")
    return (
        read.where(record)
        .select(
            F.variant_get("_title", "$", "string").alias("title"),
            F.when(year.rlike(YEAR_PATTERN), year.try_cast("int")).alias("year"),
            F.array_distinct(
                F.transform(names, lambda person: F.variant_get(person, "$", "string"))
            ).alias("authors"),
            *[c for c in lines.columns if c != "value"],
        )
        .where(F.col("year") >= since)
    )


def count_forms(lines: DataFrame) -> DataFrame:
    """``(form, lines)``: how many lines are records, misshapen JSON, or no JSON at all."""
    return _classified(lines).groupBy(F.col("_form").alias("form")).agg(F.count("*").alias("lines"))


def read_records(spark: SparkSession, path: str, since: int = 0, strict: bool = False) -> DataFrame:
    """Parse a file or folder of record lines; every line is a record of its own."""
    return parse_records(spark.read.text(path), since, strict)


def records_hypergraph(
    records: DataFrame, partition: tuple[str, int, int] | None = None
) -> HyperGraph:
    """Hypergraph of parsed records: authors are vertices, sets of authors hyperedges.

    Records are told apart by a number given here, so repeated titles stay separate.
    It is written once, because a second evaluation could number them differently.
    """
    numbered = kept(
        records.select(F.monotonically_increasing_id().alias("record"), "title", "authors"), "records"
    )
    rows = numbered.select("record", "title", F.explode("authors").alias("author"))
    return from_groups(rows, "record", "author", label="title", partition=partition, distinct=True)
