"""The stages of the corpus pipeline. Each takes and, but for the last, returns a table of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import bpe, jaccard, language, mixing, repeats
from precis.llm.common import id_remainder, written, written_to
from precis.sources.store import fresh_path, run_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those of whose n-grams no language knows ``LEAST_SHARE``."""
    filters = language.learn(docs, id_remainder(F.col("doc_id"), 3) != 1)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    found = language.identify(docs, filters, tuple(kept))
    passes = (F.col("lang_pred") != language.UNDECIDED) & (F.col("lang_score") >= LEAST_SHARE)
    return found.filter(passes).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents only the one with the smallest id stays; the text of a row that
    repeats an id is compared too, so such rows stay together with the first one. Of rows that repeat both,
    and of equal texts without an id, one stays."""
    path = fresh_path(spark, "linked-ids")
    with run_scope(spark):  # the tables of the join go before the next stage begins
        found = jaccard.similar_sets(docs)
        gone = found.filter(F.col("component") < F.col("doc")).select(F.col("doc").alias("doc_id")).distinct()
        gone = written_to(gone, path)
    return _one_of_equal_rows(docs.join(gone, "doc_id", "left_anti").select(*COLUMNS))


def _one_of_equal_rows(docs: DataFrame) -> DataFrame:
    """One row of each id (or none) and text. Digests are grouped; only rows that repeat are numbered."""
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest), 256)
    keyed = docs.withColumn("_key", key)
    repeated = written(keyed.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key"), "repeated-keys")
    again = keyed.join(repeated, "_key", "left_semi").withColumn("_row", F.monotonically_increasing_id())
    again = written(again, "repeated-rows")
    first = again.groupBy("_key").agg(F.min("_row").alias("_row")).select("_row")
    kept = keyed.join(repeated, "_key", "left_anti").unionByName(again.join(first, "_row").drop("_row"))
    return kept.select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out. Of a character that a cut goes through, the rest is dropped too."""
    kept = repeats.remove_repeats(docs, ("doc_id", "lang", "source"), ("kept_text",))
    return kept.withColumn("text", F.col("kept_text")).select(*COLUMNS[:-1], F.char_length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs)
    return mixed.select(*COLUMNS, F.explode("shards").alias("_shard")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded bytes."""
    return bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"),
    )


STAGES = [
    ("language_id", language_id), ("jaccard_join", one_of_each_group), ("suffix_dedup", suffix_dedup),
    ("mixing", mix_sources), ("byte_bpe", encode),
]
