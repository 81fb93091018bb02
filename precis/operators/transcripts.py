"""Transcript cleaning, de-duplication, topics and sampling for annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions import text
from precis.sources import store


def drop_missing(transcripts: DataFrame) -> DataFrame:
    """Drop null and blank transcripts."""
    return transcripts.dropna(subset=["transcript"]).where(~text.is_blank(F.col("transcript")))


def first_of_copies(df: DataFrame, column: str = "transcript", key: str = "doc_id") -> DataFrame:
    """Keep the row with the smallest key of each group of equal texts.

    Keys and digests are written once, so the texts are read for them only once. Copies are counted by
    digest before anything is shuffled: a text that makes up a third of the table is one row per task.
    What is dropped is then found by anti-join on the unique key. If the list of copies is too long to
    broadcast, that join shuffles the texts.
    """
    digests = store.staged(df.select(key, F.sha2(column, 256).alias("_digest")), "digests")
    firsts = digests.groupBy("_digest").agg(
        F.min(key).alias("_first"), F.count(F.lit(1)).alias("_copies")
    )
    repeated = firsts.where(F.col("_copies") > 1).select("_digest", "_first")
    copies = (
        digests.join(repeated, "_digest").where(F.col(key) != F.col("_first")).select(key)
    )
    return df.join(copies, key, "left_anti")


def clean(transcripts: DataFrame, min_tokens: int = fixed.MIN_TRANSCRIPT_TOKENS) -> DataFrame:
    """Cleaned, de-duplicated transcripts of at least ``min_tokens`` words.

    The stored ``transcript`` has its whitespace collapsed. Copies are dropped on the raw text, so texts that only become equal by
    cleaning are all kept, and the passes that look for copies clean nothing.
    """
    made = text.let(
        text.collapse_space(F.col("transcript")),
        lambda t: text.let(text.clean_transcript(t), lambda c: F.struct(
            t.alias("transcript"), c.alias("transcript_clean"), text.token_count(c).alias("token_count"))),
    )
    # As a filter on the new columns the cleaning would be pushed down and run a second time.
    long_enough = F.filter(F.array(made), lambda x: x["token_count"] >= min_tokens)
    others = [c for c in transcripts.columns if c != "transcript"]
    return first_of_copies(drop_missing(transcripts)).select(*others, F.inline(long_enough))


def with_sections(cleaned: DataFrame, size: int = fixed.SECTION_WORDS) -> DataFrame:
    """Add ``lecture_section``: the cleaned text cut into runs of ``size`` words."""
    words = text.words(F.col("transcript_clean"))
    return cleaned.withColumn("lecture_section", text.word_sections(words, size))


def with_topic(df: DataFrame) -> DataFrame:
    return df.withColumn("topic", text.topic_of(F.col("playlist_name")))


def balanced_weights(df: DataFrame, column: str) -> DataFrame:
    """``n / (classes * n_class)`` per class."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # The window sees one row per class, after the counts are summed.
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    classes = F.count(F.lit(1)).over(everything)
    return sizes.select(column, "n", (total / (classes * F.col("n"))).alias("weight"))


def group_sizes(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def seeded_hash(seed: int, *keys: str):
    """Hash that orders rows at random but always the same way."""
    parts = [c for k in keys for c in (F.lit(":"), F.col(k).cast("string"))]
    return F.md5(F.concat(F.lit(str(seed)), *parts))


def sample_per_topic(
    lectures: DataFrame,
    n: int = fixed.SAMPLES_PER_TOPIC,
    token_range: tuple[int, int] = fixed.SAMPLE_TOKEN_RANGE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """``n`` lectures per topic out of those within the token range; smaller topics give all.

    Spark keeps the first ``n`` per topic in every task before the shuffle (WindowGroupLimit), so a
    dominant topic costs ``n`` rows per task. Only keys are ranked; the rows are joined back.
    """
    candidates = lectures.where(F.col("token_count").between(*token_range))
    order = Window.partitionBy("topic").orderBy("_order", "doc_id")
    chosen = (
        candidates.select("doc_id", "topic", seeded_hash(seed, "doc_id").alias("_order"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= n)
        .select("doc_id")
    )
    return candidates.join(chosen, "doc_id", "left_semi")


def join_hand_summaries(sentences: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sentence rows with the hand-written summary and topic of their document."""
    return sentences.join(
        summaries.select("doc_id", "paraphrased_summary", "topic"), "doc_id", "inner"
    )
