"""Sentence labels: by ROUGE-L, by TF-IDF cosine, or from a list written by hand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions import bags, text, units
from precis.operators import features, ranking, rouge, sentences
from precis.sources import store

MOST_NAMES = 1 << 18  # terms with idf that every task may hold
SUMMARY_ROW = -1  # sentence_id of the row that holds the summary of a document


def label_by_overlap(
    pairs: DataFrame,
    k: int = fixed.TOP_K_ROUGE,
    cap: int | None = None,
    stem: bool = True,
) -> DataFrame:
    """Label 1 for the ``k`` sentences with the best ROUGE-L against the summary.

    ``(doc_id, sentence_id, sentence, score, label)``. Splitting, scoring and choosing all happen
    within the row of the document, so the only shuffle is the one that brought the pair together.
    ``cap`` reads only the first sentences of a document. A null document has no sentences; with a
    null summary all scores are 0.
    """
    docs = rouge.sentence_overlap(sentences.plain_sentences(pairs, "document", cap), stem)
    chosen = docs.select(
        "doc_id", "sentences", "scores",
        ranking.top_k_of_array(F.col("scores"), k).alias("_top"),
    )
    rows = sentences.sentence_rows(chosen, "scores", "_top")
    return rows.select(
        "doc_id", "sentence_id", "sentence",
        F.get("scores", F.col("sentence_id")).alias("score"),
        F.array_contains("_top", F.col("sentence_id")).cast("int").alias("label"),
    )


_COMMON = "array<struct<term: string, tf: int, summary_tf: int>>"


def _units(documents: DataFrame, stop_words: list[str], max_n: int) -> DataFrame:
    """Each sentence, and the summary as row -1, with its term counts and the summary's counts of its terms.

    ``_common`` and ``_summary_tf`` have only terms of the sentence itself, so that a summary is not written once
    per sentence.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from bags.unit_batches(batch["doc_id"], batch["_units"], max_n)

    tokens = F.transform(F.concat("sentences", F.array("summary")), lambda u: text.feature_tokens(u, stop_words))
    key = documents.schema["doc_id"].dataType.simpleString()
    made = documents.select("doc_id", tokens.alias("_units")).mapInArrow(
        rows, f"doc_id {key}, n_sentences int, sentence_id int, terms array<struct<term: string, tf: int>>, _common {_COMMON}"
    )
    counts = F.transform("_common", lambda c: F.struct(c["term"], c["summary_tf"]))
    return made.withColumn("_summary_tf", F.map_from_entries(counts))


def fit_summary_idf(
    documents: DataFrame,
    stop_words: list[str],
    max_n: int = 2,
    max_features: int = fixed.MAX_FEATURES,
    summary_once: bool = False,
) -> DataFrame:
    """Vectorizer over all sentences and summaries.

    By default a summary counts once for every sentence of its document. It is not repeated for
    that; its row carries the number as a weight.
    """
    tokens = unit_tokens(documents, stop_words)
    return _idf_of_units(tokens, max_n, max_features, summary_once)


def unit_tokens(documents: DataFrame, stop_words: list[str]) -> DataFrame:
    """``(doc_id, _units)`` of ``doc_id, sentences, summary``: tokens of each sentence and, last, of the summary; written."""
    return store.staged(_unit_tokens(documents, stop_words), "units")


def _unit_tokens(documents: DataFrame, stop_words: list[str]) -> DataFrame:
    """``(doc_id, _units)``: tokens of each sentence and, last, of the summary, separated by blanks."""
    @F.arrow_udf("array<string>")
    def joined(lists: pa.Array) -> pa.Array:
        texts = units.joined(lists.flatten())
        return pa.ListArray.from_arrays(pa.array(bags._ends(bags._lengths(lists)).astype(np.int32)), texts)

    made = F.transform(F.concat("sentences", F.array("summary")), lambda u: text.feature_tokens(u, stop_words))
    return documents.select("doc_id", joined(made).alias("_units"))


def _idf_of_units(tokens: DataFrame, max_n: int, max_features: int, summary_once: bool) -> DataFrame:
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bags.BUCKET_BITS, np.int64)
        for _, part in units.pieces(batches, max_n):
            found += part.totals(summary_once)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["at", "total"])

    def stats_of(kept: np.ndarray) -> DataFrame:
        def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in units.pieces(batches, max_n):
                yield part.stats(kept, summary_once)

        return tokens.select("_units").mapInArrow(stats, "term string, df long, total_tf long").groupBy("term").agg(
            F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")
        )

    sums = features.summed_buckets(tokens.select("_units").mapInArrow(totals, "at long, total long"))
    n_sentences = F.size("_units") - 1
    n = F.when(F.size("_units") > 0, n_sentences + (F.lit(1) if summary_once else n_sentences)).otherwise(0)
    rows = tokens.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).scalar()
    return features.with_idf(features.most_frequent_by_buckets(sums, stats_of, max_features), rows)


def cosine_scores(
    documents: DataFrame, idf: DataFrame, stop_words: list[str], max_n: int = 2
) -> DataFrame:
    """Cosine of every sentence with the summary of its document: ``(doc_id, sentence_id, score)``.

    ``documents`` holds ``doc_id, sentences, summary``; ``idf`` comes from :func:`fit_summary_idf`
    and has at most ``max_features`` rows. Each task sums the terms of a sentence before the shuffle, so one small row
    per sentence moves; above ``MOST_NAMES`` terms they are joined.
    """
    return _scores(documents, _unit_tokens(documents, stop_words), idf, stop_words, max_n)


def _sums_by_names(tokens: DataFrame, idf: DataFrame, max_n: int) -> DataFrame:
    """``(doc_id, sentence_id, _dot, _own)`` within each document, where the terms of ``idf`` fit into every task."""
    listed = idf.select("term", "idf").toArrow()
    known = units.Known(listed["term"].combine_chunks(), listed["idf"].to_numpy())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in units.pieces(batches, max_n):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(part.doc)), pa.array(part.numbers().astype(np.int32)), *map(pa.array, part.sums(known))],
                ["doc_id", "sentence_id", "_dot", "_own"],
            )

    key = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(sums, f"doc_id {key}, sentence_id int, _dot double, _own double")


def _sums_by_join(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """The same per term, for any number of terms."""
    in_summary = F.map_from_entries(F.transform("_common", lambda c: F.struct(c["term"], c["summary_tf"])))
    rows = rows.select("doc_id", "sentence_id", in_summary.alias("_in"), F.explode_outer(text.whole(F.col("terms"))).alias("_t")).select(
        "doc_id", "sentence_id", "_t.term", "_t.tf", F.coalesce(F.try_element_at("_in", "_t.term"), F.lit(0)).alias("summary_tf")
    )
    square = F.col("idf") * F.col("idf")
    return rows.join(idf.select("term", "idf"), "term", "left").select(
        "doc_id", "sentence_id",
        (F.col("tf") * F.col("summary_tf") * square).alias("_dot"), (F.col("tf") * F.col("tf") * square).alias("_own"),
    )


def _scores(documents: DataFrame, tokens: DataFrame, idf: DataFrame, stop_words: list[str], max_n: int) -> DataFrame:
    if idf.count() <= MOST_NAMES:
        rows = _sums_by_names(tokens, idf, max_n)
    else:
        rows = _sums_by_join(_units(documents, stop_words, max_n), idf)
    sums = rows.groupBy("doc_id", "sentence_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("_dot", "_own")]
    )
    of_summary = F.max(F.when(F.col("sentence_id") == SUMMARY_ROW, F.col("_own")))
    lengths = F.sqrt("_own") * F.sqrt("_summary")
    return (
        sums.withColumn("_summary", of_summary.over(Window.partitionBy("doc_id")))
        .where(F.col("sentence_id") != SUMMARY_ROW)
        .select(
            "doc_id", "sentence_id",
            F.when(lengths > 0, F.col("_dot") / lengths).otherwise(F.lit(0.0)).alias("score"),
        )
    )


def label_by_cosine(
    documents: DataFrame,
    stop_words: list[str],
    k: int = fixed.TOP_K_COSINE,
    max_features: int = fixed.MAX_FEATURES,
    summary_once: bool = False,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """Label 1 for the ``k`` sentences closest to the summary; the later sentence wins ties.

    ``tokens`` are the :func:`unit_tokens` of the documents, where the caller has them.
    """
    # The tokens are made once and written; the statistics and the scores both read them.
    tokens = unit_tokens(documents, stop_words) if tokens is None else tokens
    idf = store.staged(_idf_of_units(tokens, 2, max_features, summary_once), "idf")
    return ranking.with_top_k(_scores(documents, tokens, idf, stop_words, 2), k, ties="last")


def _positives(labels: DataFrame) -> DataFrame:
    """``(doc_id, _positives)``: the positions of the positives, at most k per document."""
    return labels.where(F.col("label") == 1).groupBy("doc_id").agg(F.collect_list("sentence_id").alias("_positives"))


def _hit() -> Column:
    return F.array_contains("_positives", F.col("sentence_id")).cast("int")


def attach_labels(documents: DataFrame, labels: DataFrame, *carry: str) -> DataFrame:
    """Labelled sentence rows from ``(doc_id, sentences)`` and ``(doc_id, sentence_id, label)``.

    Only the positions of the positives are brought to the document row.
    """
    rows = sentences.sentence_rows(documents.join(_positives(labels), "doc_id"), "_positives", *carry)
    return rows.select("doc_id", "sentence_id", "sentence", _hit().alias("label"), *carry)


def attach_to_terms(tokens: DataFrame, labels: DataFrame, *carry: str) -> DataFrame:
    """The same with the term counts in place of the sentence, from the :func:`unit_tokens` of the documents."""
    rows = tokens.join(_positives(labels), "doc_id").select(
        "doc_id", "_positives", *carry,
        F.posexplode(F.slice("_units", F.lit(1), F.greatest(F.size("_units") - 1, F.lit(0)))).alias("sentence_id", "_unit"),
    )

    @F.arrow_udf("array<struct<term: string, tf: int>>")
    def counted(tokens: pa.Array) -> pa.Array:
        return bags.counted(tokens, 1)

    terms = counted(F.filter(F.split("_unit", " "), lambda t: t != ""))
    return rows.select("doc_id", "sentence_id", _hit().alias("label"), *carry, terms.alias("terms"))


def label_by_hand(notes: DataFrame, hand_labels: DataFrame) -> DataFrame:
    """Label 1 for sentences that occur verbatim in the list of their file; no list, all 0.

    ``notes`` holds ``file_name, sentence`` and whatever else. The list is made unique first, so
    the left join never multiplies rows.
    """
    listed = hand_labels.select("file_name", "sentence").distinct().withColumn("_hit", F.lit(1))
    return notes.join(listed, ["file_name", "sentence"], "left").select(
        *notes.columns, F.coalesce("_hit", F.lit(0)).alias("label")
    )


def label_distribution(labeled: DataFrame, *by: str) -> DataFrame:
    """Positives, negatives and the positive fraction."""
    positives = F.coalesce(F.sum("label"), F.lit(0))
    n = F.count(F.lit(1))
    return labeled.groupBy(*by).agg(
        positives.alias("positives"),
        (n - positives).alias("negatives"),
        (positives / F.greatest(n, F.lit(1))).alias("positive_fraction"),
    )


def positive_weight(labeled: DataFrame) -> DataFrame:
    """``n_neg / n_pos`` as one row; null without positives."""
    return labeled.agg(
        F.try_divide(F.sum(1 - F.col("label")), F.sum("label")).alias("positive_weight")
    )

