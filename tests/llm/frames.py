"""Small document tables for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators might use inside, and one that differs from a column in case only.
EXTRA = "hash n size key fp x y place placed of whole below copy blob cell group_size bucket".split()

LONG = "lengthy words " * 20_000 + "password=abcdef123"

AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "", "en", None, 0),
    (4, "same text with five words", "en", "a", 5),
    (5, "same text with five words", "de", "b", 5),
    (5, "same text with five words", "de", "b", 5),
    (5, "another text under a repeated id", "de", "b", 5),
    (None, "same text with five words", "en", "a", 5),
    (None, None, None, None, None),
    (6, LONG, "en", "a", 9),
    (7, "  \t\n ", "en", "a", 9),
    (8, "Über ñandú 日本語 \U0001f600 straße", "de", "ä", 9),
    (9, "x" * 50_000, "en", "a", 9),
    (10, "12345 67890 !!", None, "a", 9),
]


def documents(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(*row, *[None] * (5 - len(row))) for row in rows], SCHEMA)


def with_clashing_columns(docs: DataFrame) -> DataFrame:
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(EXTRA)])


def awkward(spark: SparkSession) -> DataFrame:
    return with_clashing_columns(documents(spark, AWKWARD))


def empty(spark: SparkSession) -> DataFrame:
    return with_clashing_columns(spark.createDataFrame([], SCHEMA))


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
