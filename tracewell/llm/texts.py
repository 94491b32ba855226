"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Character classes that mean the same in Java, RE2 and the byte tables.
WORDS = r"[^\x20\x09-\x0D]+"
PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)).cast("long"), F.lit(0).cast("long"))


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``_row``, so that no column of it clashes with others; ``select("_row.*")`` undoes it."""
    return docs.select(F.struct("*").alias("_row"))


def text_marks(text: Column) -> tuple[Column, Column]:
    """Two hashes that name a text."""
    return F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), text).alias("text_b")
