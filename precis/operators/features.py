"""TF-IDF in long form: ``(doc_id, sentence_id, term, tf, weight)``.

Term counts are taken inside the row of their sentence. The shuffles left are the term statistics
(pre-aggregated in every task) and, where a vocabulary is too large to broadcast, the join on term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions import bags, text
from precis.sources import store

ROW_KEY = ("doc_id", "sentence_id")


def with_term_counts(
    df: DataFrame, column: str, stop_words: list[str], max_n: int = 1, name: str = "terms"
) -> DataFrame:
    """Add the ``array<struct<term, tf>>`` of a text column, in term order. A null text has no terms."""
    if max_n not in (1, 2):
        raise ValueError(f"max_n must be 1 or 2, not {max_n}")

    @F.arrow_udf("array<struct<term: string, tf: int>>")
    def counted(tokens: pa.Array) -> pa.Array:
        return bags.counted(tokens, max_n)

    return df.withColumn(name, counted(text.feature_tokens(F.col(column), stop_words)))


def term_rows(df: DataFrame, *carry: str, terms: str = "terms") -> DataFrame:
    """Explode the term counts, keeping the ``carry`` columns."""
    return df.select(*carry, F.explode(text.whole(F.col(terms))).alias("_t")).select(*carry, "_t.term", "_t.tf")


def term_stats(counted: DataFrame, weight: Column | None = None, kept: np.ndarray | None = None) -> DataFrame:
    """Document frequency and total frequency per term, or of those in ``kept`` buckets; a row counts ``weight`` times."""
    return _partial_stats(counted, weight, kept).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")
    )


def n_rows(counted: DataFrame, weight: Column | None = None) -> Column:
    """Number of rows as a scalar subquery."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return counted.agg(F.coalesce(total, F.lit(0)).alias("n")).scalar()


def with_idf(stats: DataFrame, n: Column) -> DataFrame:
    """Smoothed inverse document frequency, ``ln((1 + n) / (1 + df)) + 1``."""
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    return stats.withColumn("idf", idf)


def _partial_stats(counted: DataFrame, weight: Column | None, kept: np.ndarray | None = None) -> DataFrame:
    """``(term, df, total_tf)``, summed over the rows of a batch; only terms of the ``kept`` buckets."""
    times = F.lit(1) if weight is None else weight

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bags.gathered(batches):
            row, term, tf = bags.entries(batch["terms"], "tf")
            if kept is not None:
                chosen = np.flatnonzero(kept[bags.buckets(term)])
                row, term, tf = row[chosen], term.take(pa.array(chosen)), tf[chosen]
            times = batch["_w"].to_numpy(zero_copy_only=False)[row]
            found = term.dictionary_encode()
            codes, n = found.indices.to_numpy(zero_copy_only=False), len(found.dictionary)
            yield pa.RecordBatch.from_arrays(
                [found.dictionary, *(pa.array(np.bincount(codes, x, n).astype(np.int64)) for x in (times, times * tf))],
                ["term", "df", "total_tf"],
            )

    rows = counted.select(times.cast("long").alias("_w"), "terms")
    return rows.mapInArrow(sums, "term string, df long, total_tf long")


def _bucket_totals(counted: DataFrame, weight: Column | None) -> np.ndarray:
    """Total frequency of the terms of each bucket: a fixed number of sums, whatever the rows."""
    times = F.lit(1) if weight is None else weight

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << bags.BUCKET_BITS, np.int64)
        for batch in batches:
            row, term, tf = bags.entries(batch["terms"], "tf")
            added = batch["_w"].to_numpy(zero_copy_only=False)[row] * tf
            totals += np.bincount(bags.buckets(term), added, len(totals)).astype(np.int64)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["at", "total"])

    rows = counted.select(times.cast("long").alias("_w"), "terms").mapInArrow(sums, "at long, total long")
    return summed_buckets(rows)


def summed_buckets(rows: DataFrame) -> np.ndarray:
    """Totals of all buckets from ``(at, total)`` of the tasks."""
    found = rows.groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    totals = np.zeros(1 << bags.BUCKET_BITS, np.int64)
    totals[found["at"].to_numpy()] = found["total"].to_numpy()
    return totals


def frequent_term_stats(counted: DataFrame, n: int, weight: Column | None = None) -> DataFrame:
    """Statistics of the ``n`` terms with the largest total frequency, as :func:`most_frequent` of all would give.

    Terms fall into buckets, and none is more frequent than its bucket. Only terms of buckets that reach a bound
    are counted by name; if fewer than ``n`` of them reach it too, the bound was too high and is lowered.
    ``counted`` is read at least twice, so it should be a written table.
    """
    return most_frequent_by_buckets(
        _bucket_totals(counted, weight), lambda kept: term_stats(counted, weight, kept), n
    )


def most_frequent_by_buckets(totals: np.ndarray, stats_of: Callable[[np.ndarray], DataFrame], n: int) -> DataFrame:
    """The same from the totals of all buckets and the statistics of the terms of some."""
    bound = int(np.sort(totals)[-min(n, len(totals))]) // 2
    while True:
        stats = stats_of(totals >= bound)
        found = store.staged(most_frequent(stats, n), "frequent-terms")
        if bound == 0 or found.where(F.col("total_tf") >= bound).count() >= n:
            return found
        bound //= 4


def most_frequent(stats: DataFrame, n: int = fixed.MAX_FEATURES) -> DataFrame:
    """The ``n`` terms with the largest total frequency; equal ones in alphabetical order."""
    return stats.orderBy(F.desc("total_tf"), F.asc("term")).limit(n)


def fit_idf(
    counted: DataFrame, max_features: int | None = None, weight: Column | None = None
) -> DataFrame:
    """Frozen vectorizer ``(term, df, total_tf, idf)`` of rows with term counts."""
    if max_features is None:
        stats = term_stats(counted, weight)
    else:
        stats = frequent_term_stats(counted, max_features, weight)
    return with_idf(stats, n_rows(counted, weight))


def weights(counted: DataFrame, idf: DataFrame, key: tuple[str, ...] = ROW_KEY) -> DataFrame:
    """Unit-length TF-IDF rows under a frozen vectorizer; unknown terms are ignored.

    The join carries no hint: the planner broadcasts ``idf`` if its measured size allows and splits
    skewed terms of a shuffled join otherwise. A row is gathered again as one small array.
    """
    joined = term_rows(counted, *key).join(idf.select("term", "idf"), "term")
    raw = joined.select(*key, "term", "tf", (F.col("tf") * F.col("idf")).alias("_raw"))
    gathered = raw.groupBy(*key).agg(
        F.collect_list(F.struct("term", "tf", "_raw")).alias("_terms"),
        F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"),
    )
    return gathered.select(*key, "_norm", F.explode("_terms").alias("_t")).select(
        *key, "_t.term", "_t.tf", (F.col("_t._raw") / F.col("_norm")).alias("weight")
    )
