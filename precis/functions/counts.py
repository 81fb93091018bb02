"""Bags of tokens held inside one row.

A text is one row, so counting its tokens needs no shuffle: the array is sorted and cut into runs.
Everything here is linear in the number of tokens apart from that sort.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.functions.text import let


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, in term order."""
    return let(
        F.sort_array(tokens), lambda ts: let(run_starts(ts), lambda starts: runs_to_counts(ts, starts))
    )


def run_starts(sorted_tokens: Column) -> Column:
    """1-based positions at which a new token begins in a sorted array."""
    positions = F.filter(
        F.sequence(F.lit(1), F.size(sorted_tokens)),
        lambda i: (i == 1) | (F.get(sorted_tokens, i - 1) != F.get(sorted_tokens, i - 2)),
    )
    return F.when(F.size(sorted_tokens) > 0, positions).otherwise(F.array().cast("array<int>"))


def runs_to_counts(sorted_tokens: Column, starts: Column) -> Column:
    """``array<struct<term, tf>>`` from a sorted token array and the starts of its runs."""
    end = F.size(sorted_tokens) + 1
    return F.transform(
        starts,
        lambda s, j: F.struct(
            F.get(sorted_tokens, s - 1).alias("term"),
            (F.coalesce(F.get(starts, j + 1), end) - s).alias("tf"),
        ),
    )
