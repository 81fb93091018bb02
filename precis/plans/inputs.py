"""The given tables in the shapes this package works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Playlist of each document source; together they reach every topic.
PLAYLISTS = {
    "src0": "CS224N Natural Language Processing",
    "src1": "Hugging Face Course",
    "src2": "Deep Learning with Transformers",
    "src3": "Albert Explains Proofs",
    "src4": "Reinforcement Learning Lectures",
    "src5": "URL Shortener in Flask",
    "src6": "CS229 Autumn",
    "src7": "Neural Network Zero to Hero",
    "src8": "MIT Advanced Machine Learning",
    "src9": "Two Minute Papers",
    "src10": "Age of A.I.",
    "src11": "Thai Cooking",
    "src12": "Linear Algebra",
    "src13": "PyData Global",
    "src14": "Pandas Tutorial",
    "src15": "Django Web Apps",
    "src16": "PyTorch Basics",
    "src17": "Lex Fridman Interviews",
    "src18": "Our Story",
    "src19": "Gardening Basics",
}
TURN_BITS = 1 << 32  # doc_id of a conversation turn: conv_id * TURN_BITS + turn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, document)``."""
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("document"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, transcript, title, playlist_name)``."""
    names = F.create_map(*[F.lit(x) for pair in PLAYLISTS.items() for x in pair])
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").alias("transcript"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.try_element_at(names, F.col("source")).alias("playlist_name"),
    )


def numbered_passages(spark: SparkSession, folder: str) -> DataFrame:
    """``(item_id, text)`` of ``benchmark``, numbered from 0 without gaps."""
    passages = table(spark, folder, "benchmark").select("item_id", "text")
    number = F.row_number().over(Window.orderBy("item_id")).cast("long") - 1
    return passages.select(number.alias("item_id"), "text")


def with_summary(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add ``summary``: the passages of ``benchmark`` dealt out in turn to all documents.

    The remainder is the join key that gives every document its passage. The passages are numbered
    here, so none is left out whatever their ids are; the table is small, one window orders it. A null id counts as 0.
    """
    passages = numbered_passages(spark, folder).withColumnRenamed("text", "summary")
    n = passages.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.withColumn("item_id", F.pmod(F.coalesce("doc_id", F.lit(0)), n)).join(passages, "item_id").drop("item_id")


def gold_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, summary)`` of every document."""
    ids = table(spark, folder, "documents").select("doc_id")
    return with_summary(ids, spark, folder)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, document, summary)``: every document with its passage."""
    return with_summary(documents(spark, folder), spark, folder)


def conversation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, document, summary)``: each assistant turn with the user turn before it."""
    turns = table(spark, folder, "conversations")
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("document")
    )
    questions = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("summary")
    )
    return answers.join(questions, ["conv_id", "turn"]).select(
        (F.col("conv_id") * TURN_BITS + F.col("turn")).alias("doc_id"), "document", "summary"
    )
