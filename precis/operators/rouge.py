"""ROUGE-1, ROUGE-2 and ROUGE-L of text pairs.

Both texts of a pair sit in one row, so nothing is exploded or shuffled: n-gram overlaps and longest common
subsequences are counted by Arrow batches (``functions.overlaps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions import lcs, overlaps, stemming, text

METRICS = ("rouge1", "rouge2", "rougeL")


def prf(overlap: Column, n_candidate: Column, n_reference: Column) -> Column:
    """Precision, recall and F1; each is 0 where its denominator is 0."""
    p = F.when(n_candidate > 0, overlap / n_candidate).otherwise(F.lit(0.0))
    r = F.when(n_reference > 0, overlap / n_reference).otherwise(F.lit(0.0))
    # 2PR / (P + R) written over the counts: one division instead of four.
    both = n_candidate + n_reference
    f = F.when(both > 0, F.lit(2.0) * overlap / both).otherwise(F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), f.alias("f"))


def score_pairs(
    pairs: DataFrame,
    candidate: str = "text",
    reference: str = "reference",
    metrics: tuple[str, ...] = METRICS,
    stem: bool = True,
) -> DataFrame:
    """Add one ``struct<p, r, f>`` per metric to rows that hold a candidate and a reference.

    A null text counts as empty, so all its scores are 0.
    """
    texts = [text.rouge_text(F.coalesce(F.col(c), F.lit(""))) for c in (candidate, reference)]
    df = pairs.withColumn("_common", overlaps.common(tuple(metrics), stem)(*texts))
    n, n_reference = F.col("_common.n"), F.col("_common.n_reference")
    # A text of n tokens has n - 1 bigrams, the empty one none.
    pairs_of = lambda count: F.greatest(count - 1, F.lit(0))
    for metric in METRICS:
        if metric in metrics:
            sizes = (pairs_of(n), pairs_of(n_reference)) if metric == "rouge2" else (n, n_reference)
            df = df.withColumn(metric, prf(F.col(f"_common.{metric}"), *sizes))
    return df.select(*pairs.columns, *metrics)


def score_systems(
    candidates: DataFrame,
    references: DataFrame,
    metrics: tuple[str, ...] = METRICS,
    stem: bool = True,
    skip_empty: bool = False,
) -> DataFrame:
    """ROUGE record per ``(system, doc_id)``: candidates joined to the reference of their document.

    ``skip_empty`` leaves empty candidates unscored, as for failed replies of an outside system;
    otherwise they score 0.
    """
    if skip_empty:
        candidates = candidates.where(F.length("text") > 0)
    golds = references.select("doc_id", F.col("summary").alias("reference"))
    pairs = candidates.select("system", "doc_id", "text").join(golds, "doc_id")
    return score_pairs(pairs, metrics=metrics, stem=stem).select("system", "doc_id", *metrics)


def mean_scores(records: DataFrame, *metrics: str) -> DataFrame:
    """Mean F1 per system; no records, no rows."""
    means = [F.avg(f"{m}.f").alias(f"{m}_f") for m in metrics]
    return records.groupBy("system").agg(F.count(F.lit(1)).alias("n_docs"), *means)


def flat(records: DataFrame, metric: str, digits: int = 6) -> list[Column]:
    """The three numbers of one metric as plain rounded columns."""
    return [
        F.round(f"{metric}.{part}", digits).alias(f"{metric}_{part}") for part in ("p", "r", "f")
    ]


def sentence_overlap(documents: DataFrame, stem: bool = True) -> DataFrame:
    """Add ``scores``: ROUGE-L F1 of each sentence of ``sentences`` with ``summary``.

    The sentences of a document travel to Python as lines of one string together with the summary,
    whose tokens are therefore prepared once per document rather than once per sentence.
    """
    given = F.coalesce("sentences", F.array().cast("array<string>"))
    df = documents.withColumn("_lines", F.transform(given, text.rouge_text)).withColumn(
        "_summary", text.rouge_text(F.coalesce(F.col("summary"), F.lit("")))
    )
    lines, reference = F.array_join("_lines", "\n"), F.col("_summary")
    if stem:
        lines, reference = stemming.stem_text(lines), stemming.stem_text(reference)
    df = df.select(
        *documents.columns,
        lcs.lcs_lines(lines, reference).alias("_lcs"),
        F.transform("_lines", text.token_count).alias("_n"),
        text.token_count(F.col("_summary")).alias("_m"),
    )
    scores = F.zip_with("_lcs", "_n", lambda hit, n: prf(hit, n, F.col("_m"))["f"])
    return df.withColumn("scores", scores).drop("_lcs", "_n", "_m")
