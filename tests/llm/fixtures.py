"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words string, a long, fp long, key string, size long, "
    "_id long, _times long, _found string, _v_kept boolean, row long, copy long, ref string, kept boolean, stays boolean, times int"
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 12) for _ in range(4000))
    shared = words(rng, 60)
    rows = [
        (1, "", "en", "s1"),
        (2, None, "en", "s1"),
        (3, long, "en", None),
        (4, long + "\n" + words(rng, 30), None, "s1"),
        (5, shared, "fr", "s2"),
        (5, shared, "fr", "s2"),
        (6, shared, "fr", "s2"),
        (7, words(rng, 10) + "\n" + shared + "\n" + words(rng, 10), "fr", "s3"),
        (None, shared, None, None),
        (None, None, None, None),
        (9, " \t\n \n", "en", "s1"),
        (10, "one", "en", "é"),
        (11, "the same word " * 40, "en", "s1"),
        (12, "x" * 30000, "de", "s1"),
    ]
    return spark.createDataFrame([(*r, None, "n", 1, None, "k", None, 7, 0, "f", False, 8, 9, "r", False, False, 0) for r in rows], COLUMNS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def texts(df: DataFrame) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
