"""Chat formatting as a relational job: sorted turn structs, merged blocks, one formatted string per conversation.

Template (fixed values): a block is a run of adjacent turns of one role. It opens with ``### <role>: ``, holds its turns
one after the other, each closed by ``</turn>``, and blocks are separated by a line feed. In texts and roles a backslash is
written ``\\b``, ``<`` is written ``\\l``, ``#`` is written ``\\h`` and, in roles, ``:`` is written ``\\c``. No control string
can then arise from content, and reading back gives every role and text exactly. Only Spark expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, ROLE_END, TURN_END, BETWEEN = "### ", ": ", "</turn>", "\n"
LEARNER = "assistant"


def escape(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text is followed by its code letter, so plain replacements undo them."""
    for char, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _blocks(parts: Column) -> Column:
    """Runs of adjacent parts with one role, as ``(role, texts)``; work is linear in the number of turns."""
    size = F.size(parts)
    starts = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == 1) | (F.element_at(parts, i)["role"] != F.element_at(parts, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    return F.transform(
        starts,
        lambda start, k: F.struct(
            F.element_at(parts, start)["role"].alias("role"),
            F.transform(
                F.slice(parts, start, F.coalesce(F.get(starts, k + 1), size + 1) - start), lambda p: p["text"]
            ).alias("texts"),
        ),
    )


def _pieces(blocks: Column) -> Column:
    """Strings whose concatenation is the formatted text, each with a flag that says whether a loss is taken over it."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column, k: Column) -> Column:
        role = F.replace(escape(b["role"]), F.lit(":"), F.lit("\\c"))
        head = F.concat(F.when(k > 0, F.lit(BETWEEN)).otherwise(F.lit("")), F.lit(OPEN), role, F.lit(ROLE_END))
        turns = F.transform(
            b["texts"],
            lambda t: F.array(piece(escape(t), b["role"] == LEARNER), piece(F.lit(TURN_END), F.lit(False))),
        )
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(turns))

    return F.flatten(F.transform(blocks, block))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` and ``mask``.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are ignored. Turns are ordered by ``turn`` (null first), ties
    by role and text, so repeated rows stay repeated turns and reruns agree. A null text or role counts as empty, rows
    with a null ``conv_id`` form one conversation, an empty table gives an empty table. ``mask`` lists ``(start, length)`` of
    every non-empty assistant text inside ``formatted`` (escaped there), in code points from 0. A conversation is one
    output string, so its own turns meet in one aggregate; nothing else is gathered.
    """
    part = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    parts = turns.select("conv_id", part.alias("part")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts")
    )
    blocks = parts.select("conv_id", _blocks(F.col("parts")).alias("blocks"))
    pieces = blocks.select("conv_id", _pieces(F.col("blocks")).alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start int, length int>>)").alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["loss"] & (F.length(p["text"]) > 0),
                F.concat(
                    done["spans"],
                    F.array(F.struct(done["at"].alias("start"), F.length(p["text"]).alias("length"))),
                ),
            ).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    formatted = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return pieces.select("conv_id", formatted.alias("formatted"), spans.alias("mask"))


def turns_of(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted string alone."""

    def block(b: Column) -> Column:
        head = F.substring_index(b, ROLE_END, 1)
        body = F.substring(b, F.length(head) + 1 + len(ROLE_END), F.length(b))
        texts = F.split(body, TURN_END)
        return F.transform(
            F.slice(texts, 1, F.size(texts) - 1),
            lambda t: F.struct(unescape(head).alias("role"), unescape(t).alias("text")),
        )

    opened = F.split(formatted, f"(^|{BETWEEN}){OPEN}")
    return F.flatten(F.transform(F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0))), block))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    parts = F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"])))
    return F.array_join(parts, "")


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and the probe conversation -7, with digests of what is read back from the formatted strings."""
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, LEARNER, PROBE)], "conv_id long, turn long, role string, text string"
    )
    done = format_conversations(table.unionByName(probe)).select(
        "conv_id",
        turns_of(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op9_chat_format": op9_chat_format}
SQL = {
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
), e AS (
  SELECT *, before IS NULL OR before <> role AS opens,
    len(text) + len(regexp_extract_all(text, '[\\<#]')) + 7 AS body,
    len(role) + len(regexp_extract_all(role, '[\\<#:]')) + 6 AS head
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body) + coalesce(sum(head) FILTER (opens), 0) + count(*) FILTER (opens) - 1 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
