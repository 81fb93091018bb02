"""Fixed-length id sequences for a sequence-to-sequence model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions.text import WORD
from precis.sources import store

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2
VOCABULARY_SIZE = 50_000


def _word_array(column: str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(f"({WORD}+)"), F.lit(1))


def fit_vocabulary(pairs: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """``(word, id)``: the ``size`` most frequent words of documents and summaries; all others are unknown."""
    every = pairs.select(F.explode(_word_array("document")).alias("word")).unionAll(
        pairs.select(F.explode(_word_array("summary")).alias("word"))
    )
    common = (
        every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "word").limit(size)
    )
    # At most ``size`` rows are left to number. Written, because each side of the pairs reads it.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return store.staged(common.select("word", (place + (FIRST_WORD_ID - 1)).alias("id")), "vocabulary")


def to_padded_ids(pairs: DataFrame, vocabulary: DataFrame, column: str, length: int) -> DataFrame:
    """``(doc_id, ids)`` of exactly ``length`` ids: cut, or filled up with the padding id.

    The join carries no hint; the planner broadcasts the vocabulary if it is small. Words past
    ``length`` are cut before they are exploded.
    """
    rows = pairs.select(
        "doc_id", F.posexplode_outer(F.slice(_word_array(column), 1, length)).alias("pos", "word")
    )
    ids = rows.join(vocabulary, "word", "left")
    in_order = F.sort_array(
        F.collect_list(F.when(
            F.col("pos").isNotNull(),
            F.struct("pos", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id")),
        ))
    )
    found = F.transform(in_order, lambda x: x["id"])
    padded = F.concat(F.col("_ids"), F.array_repeat(F.lit(PAD_ID), F.lit(length) - F.size("_ids")))
    return ids.groupBy("doc_id").agg(found.alias("_ids")).select("doc_id", padded.alias("ids"))


def prepare(
    pairs: DataFrame,
    vocabulary: DataFrame,
    input_length: int = fixed.INPUT_LENGTH,
    target_length: int = fixed.TARGET_LENGTH,
) -> DataFrame:
    """``(doc_id, input_ids, labels)``."""
    inputs = to_padded_ids(pairs, vocabulary, "document", input_length)
    targets = to_padded_ids(pairs, vocabulary, "summary", target_length)
    return inputs.withColumnRenamed("ids", "input_ids").join(
        targets.withColumnRenamed("ids", "labels"), "doc_id"
    )
