"""Feature columns (X13-X15): counts and label codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_count, joined_count, word_count

NUMERIC_FEATURES = ("nr_of_words", "nr_of_characters")


def counts(df: DataFrame, text_col: str, words: str = "nr_of_words",
           chars: str = "nr_of_characters", joined: bool = False) -> DataFrame:
    """Word count (whitespace split) and character count of a text column; ``joined``: its words are
    known to be joined by single spaces."""
    n = joined_count(text_col) if joined else word_count(text_col)
    return df.withColumn(words, n).withColumn(chars, char_count(text_col))


def class_codes(df: DataFrame, class_col: str) -> DataFrame:
    """(class, label): sorted distinct classes numbered 0..k-1.

    The table has one row per class (a bounded label set), so the unpartitioned
    window and the broadcast of the result are safe.
    """
    classes = df.where(F.col(class_col).isNotNull()).select(class_col).distinct()
    w = Window.orderBy(F.col(class_col).asc())
    return classes.withColumn("label", (F.row_number().over(w) - 1).cast("int"))


def label_encode(df: DataFrame, class_col: str, out: str = "label") -> DataFrame:
    """Add the class code (NULL for a NULL class)."""
    codes = F.broadcast(class_codes(df, class_col).withColumnRenamed("label", out))
    return df.join(codes, class_col, "left")

