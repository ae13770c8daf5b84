"""Conversation tables: request contents in order, and answers out of response payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = (
    "candidates array<struct<content: struct<parts: array<struct<text: string>>>, finishReason: string>>"
)
# Messages shown in place of an answer.
NO_CANDIDATES = "I couldn't generate a response. The model returned no candidates."
EMPTY_TEXT = "The model returned an empty response (reason: %s). Please try rephrasing your question."


def prompt_assembly(turns: DataFrame, context: Column) -> DataFrame:
    """Request contents, one row per message: earlier turns with their role, the last one led by the context.

    The result stays in rows (``conv_id, turn``) instead of one array per conversation, so a conversation of any
    length is spread over tasks. The last turn comes from an aggregate joined back, not from a per-conversation
    window, for the same reason.
    """
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    is_last = F.col("turn") == F.col("_last")
    text = F.when(is_last, F.concat(context, F.lit("\n\nUser question: "), F.col("text"))).otherwise(F.col("text"))
    role = F.when(is_last | (F.col("role") == "user"), F.lit("user")).otherwise(F.lit("model"))
    return turns.join(last, "conv_id").select("conv_id", "turn", role.alias("role"), text.alias("text"))


def content_json(contents: DataFrame) -> DataFrame:
    """Each message as the JSON object a request lists."""
    parts = F.array(F.struct("text"))
    return contents.withColumn("content", F.to_json(F.struct("role", parts.alias("parts"))))


def response_extract(payload: Column) -> Column:
    """Text of the first candidate, or the message that stands in for it."""
    candidates = F.from_json(payload, RESPONSE)["candidates"]
    first = F.try_element_at(candidates, F.lit(1))
    text = F.trim(F.array_join(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    reason = F.coalesce(first["finishReason"], F.lit("UNKNOWN"))
    return (
        F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, F.lit(NO_CANDIDATES))
        .when(F.coalesce(text, F.lit("")) == "", F.format_string(EMPTY_TEXT, reason))
        .otherwise(text)
    )
