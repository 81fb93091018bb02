"""The registered queries of this package: each runs its operator over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import (
    bpe, fingerprints, jaccard, language, merkle, mixing, phrases, repeats, shards, topk, toxicity, urls, warc,
)
from precis.llm.common import id_remainder, table
from precis.llm.oracle import ORACLES

URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    picked = docs.select("text", "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    scored = toxicity.score(picked, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, ("page_id",))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_sets(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("rep").alias("class_id"), "n_links")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies", "shards")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(
        table(spark, sf_dir, "documents"), ("doc_id",), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.learn(docs, id_remainder(F.col("doc_id"), 3) != 1)
    picked = docs.select("text", "doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    found = language.identify(picked, filters, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(f) for f in merkle.FIELDS]
    changed = [F.when(drawn, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    other = F.when(drawn, merkle.record_digest(changed)).otherwise(merkle.record_digest(fields))
    made = merkle.manifest(docs, carried={"other": other})
    made = made.withColumn("folded_root", merkle.folded(F.col("other"), F.col("proof")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language": op10_language,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_warc": op13_warc,
}

__all__ = ["ORACLES", "QUERIES", "URL_RULES"]
