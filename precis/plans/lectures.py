"""The transcript flow: clean, annotate, label against hand-written summaries, compare two systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions import text
from precis.operators import models, rouge, sentences, summaries, transcripts
from precis.plans import training


def prepare(raw: DataFrame) -> DataFrame:
    """Cleaned transcripts with sections, sentences and topic; one row per lecture."""
    cleaned = transcripts.with_sections(transcripts.clean(raw))
    return transcripts.with_topic(sentences.lecture_sentences(cleaned))


def sentence_table(lectures: DataFrame) -> DataFrame:
    rows = sentences.sentence_rows(lectures, "title", "playlist_name")
    return rows.withColumnRenamed("playlist_name", "playlist").select(
        "doc_id", "sentence_id", "sentence", "title", "playlist"
    )


def summarize(
    systems: list[training.Trained], documents: DataFrame, k: int = fixed.TOP_K_COSINE,
    column: str = "transcript",
) -> DataFrame:
    """``(system, doc_id, text)``: one summary per model; among equal scores the later sentence wins.

    The systems must share one vectorizer. Sentences and features are made once and
    scored by each model in the same stage, so a second system adds no second scan.
    """
    if any(t.vectorizer is not systems[0].vectorizer for t in systems):
        raise ValueError("the systems have different vectorizers")
    cleaned = documents.select(
        "doc_id", text.clean_transcript(F.col(column)).alias("transcript_clean")
    )
    rows = models.vectorize(
        systems[0].vectorizer, sentences.sentence_rows(sentences.lecture_sentences(cleaned))
    )
    for trained in systems:
        scored = models.predict(trained.classifier, rows)
        rows = scored.withColumnRenamed("score", f"_{trained.name}").drop("prediction")
    each = F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("system"), F.col(f"_{t.name}").alias("score")) for t in systems
    ]))
    scored = rows.select("doc_id", "sentence_id", "sentence", each.alias("_s")).select(
        "doc_id", "sentence_id", "sentence", "_s.*"
    )
    return summaries.from_sentence_rows(scored, k, ties="last", system=True)


def score_systems(candidates: DataFrame, hand_summaries: DataFrame, stem: bool = True) -> DataFrame:
    """ROUGE-1, -2 and -L records per system and lecture."""
    golds = hand_summaries.select("doc_id", F.col("paraphrased_summary").alias("summary"))
    return rouge.score_systems(candidates, golds, stem=stem)
