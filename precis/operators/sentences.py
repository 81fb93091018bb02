"""Sentence segmentation. A document keeps its sentences as one array; rows appear only on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions import text


def plain_sentences(
    df: DataFrame, column: str = "document", cap: int | None = None, name: str = "sentences"
) -> DataFrame:
    """Add the sentences of the raw text; a text without any has an empty array and yields no rows.

    ``cap`` keeps the first ``cap`` sentences of a document, as a training set may ask for.
    """
    found = text.split_sentences(F.col(column))
    return df.withColumn(name, found if cap is None else F.slice(found, 1, cap))


def lecture_sentences(
    df: DataFrame,
    column: str = "transcript_clean",
    min_chars: int = fixed.MIN_SENTENCE_CHARS,
    name: str = "sentences",
) -> DataFrame:
    """Add the sentences of a cleaned transcript: split, fall back to commas, merge short ones."""
    return df.withColumn(name, text.lecture_sentences(F.col(column), min_chars))


def sentence_rows(df: DataFrame, *carry: str, name: str = "sentences") -> DataFrame:
    """One row per sentence: ``(doc_id, sentence_id, sentence)`` plus the ``carry`` columns."""
    rows = F.posexplode(text.whole(F.col(name))).alias("sentence_id", "sentence")
    return df.select("doc_id", *carry, rows)
