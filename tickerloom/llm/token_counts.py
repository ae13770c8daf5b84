"""Exact histogram of encoded lengths, and what it answers for every context limit.

Each document is encoded once with a public byte-pair vocabulary; documents are then counted by length. The histogram has
at most as many rows as there are different lengths, and sums over its lengths give totals, quantiles and truncated
totals for every limit without another look at the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.byte_pairs import PATTERN, encode_ordinary
from tickerloom.llm.words import Cache
from tickerloom.ordering import running_totals
from tickerloom.workspace import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS = Cache()


def encoder(path: str, pattern: str):
    """A tokenizer built from a rank file; one per worker process."""
    import tiktoken

    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODERS[path, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path, pattern]


def encoded_lengths(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens``. Null and empty texts have 0 tokens; texts are encoded whole, and
    strings that look like special tokens are ordinary text; runs of white space of any length are encoded as the pattern
    would, without its limit. Only ``doc_id`` and ``text`` are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path, pattern)
        for batch in batches:
            counts = [len(encode_ordinary(encoding, text.as_py())) if text.is_valid else 0 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per encoded length ``n_tokens``, for a context limit of that many tokens:

    ``n_docs`` documents of this length; ``docs_within``, ``tokens_within`` documents and tokens up to it; ``docs_beyond``,
    ``tokens_beyond`` the suffix sums over longer documents; ``tokens_truncated`` the tokens left when every document is cut
    at the limit; ``quantile`` the share of documents within it. Between two listed lengths the answers of the lower hold, with
    ``docs_beyond`` more truncated tokens per step. An empty table gives an empty table.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = stage(counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    whole = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    summed = running_totals(counts, ["n_tokens"], {"docs_within": "n_docs", "tokens_within": "tokens"})
    summed = summed.crossJoin(F.broadcast(whole))
    beyond = summed.withColumn("docs_beyond", F.col("all_docs") - F.col("docs_within"))
    return beyond.select(
        "n_tokens", "n_docs", "docs_within", "tokens_within", "docs_beyond",
        (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_beyond"),
        (F.col("tokens_within") + F.col("docs_beyond") * F.col("n_tokens")).alias("tokens_truncated"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``; any limit, listed or not."""
    row = histogram.select(
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("total")
    ).first()
    return row["total"]


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of all documents do not exceed; None for an empty histogram."""
    return histogram.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n")).first()["n"]


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The histogram of all documents with its sums."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return length_histogram(encoded_lengths(docs))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL = {}
