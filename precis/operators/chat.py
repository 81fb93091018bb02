"""Request and reply tables for summaries written by an outside chat service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.schemas import REPLY_BODY


def requests(
    documents: DataFrame,
    model: str,
    prompt: str = fixed.SUMMARY_PROMPT,
    temperature: float = fixed.CHAT_TEMPERATURE,
    max_tokens: int = fixed.CHAT_MAX_TOKENS,
    column: str = "document",
) -> DataFrame:
    """``(doc_id, body)``: one JSON request per document. Sending it is left to the caller."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(prompt)), message("user", F.col(column))).alias("messages"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
    )
    return documents.select("doc_id", F.to_json(body).alias("body"))


def reply_texts(replies: DataFrame, system: str = "external") -> DataFrame:
    """``(system, doc_id, text)`` from reply bodies; whatever cannot be read gives the empty text."""
    content = F.from_json("body", REPLY_BODY)["choices"][0]["message"]["content"]
    return replies.select(
        F.lit(system).alias("system"), "doc_id",
        F.coalesce(F.trim(content), F.lit("")).alias("text"),
    )
