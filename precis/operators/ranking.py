"""Top-k choices per document, on score rows or on score arrays.

Scores are ranked on nine digits: sums of doubles differ in their last bits from one run to the
next, and a tie has to stay a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_DIGITS = 9


def top_k_of_array(scores: Column, k: int) -> Column:
    """Positions (0-based, ascending) of the ``k`` best scores; the lower position wins ties."""
    order = F.transform(
        scores, lambda s, i: F.struct((-F.round(s, RANK_DIGITS)).alias("s"), i.alias("i"))
    )
    best = F.transform(F.slice(F.sort_array(order), 1, k), lambda x: x["i"])
    return F.sort_array(best)


def with_top_k(
    scored: DataFrame, k: int, score: str = "score", ties: str = "first", name: str = "label",
    per: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Add 1 for the ``k`` best sentences of each document and 0 for the rest.

    ``ties`` says which sentence wins among equal scores: the ``first`` or the ``last``.
    """
    by_position = {"first": F.asc, "last": F.desc}[ties]("sentence_id")
    order = Window.partitionBy(*per).orderBy(F.desc(F.round(score, RANK_DIGITS)), by_position)
    return (
        scored.withColumn("_rank", F.row_number().over(order))
        .withColumn(name, (F.col("_rank") <= k).cast("int"))
        .drop("_rank")
    )


def top_k(
    scored: DataFrame, k: int, score: str = "score", ties: str = "first",
    per: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Only the ``k`` best sentences per document; each task keeps its own k before the shuffle."""
    by_position = {"first": F.asc, "last": F.desc}[ties]("sentence_id")
    order = Window.partitionBy(*per).orderBy(F.desc(F.round(score, RANK_DIGITS)), by_position)
    return (
        scored.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )
