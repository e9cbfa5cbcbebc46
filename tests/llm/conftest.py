import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; a table may have such columns of its own.
CLASHING = ["bits", "host", "block", "tokens", "key", "score", "page", "total", "digest", "a", "b", "label", "n", "h", "root", "vec_id", "_line_host", "_label"]
LONG = " ".join(f"word{i % 97} und{i % 13}" for i in range(30_000))


def rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    found = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "one", "en", None), (4, "one two three four\nsecond line", "en", "a"),
        (4, "one two three four\nsecond line", "en", "a"), (5, LONG, "en", "a"), (None, "there is no id here", "fr", "b"),
        (6, "one two three four\nsecond line", None, "b"), (7, "!!! ???\n\n", "de", "a"), (8, "second line\nother words of its own", "de", "a"),
        (9, "second line\nand more words here", "de", "a"), (4, "another text of the same id", "de", None),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in found]


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows(), SCHEMA).coalesce(2)
    return frame.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
