"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has sent up to and including it, in shuffled
order and over repeated passes, divided by the source's weight. Copies are range-sorted by that time over all sources and
cut where the total budget ends. A source whose passes are used up simply stops sending, and the others go on by weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.ordering import cut_at, running_total, running_totals
from tickerloom.workspace import stage

WORD = r"[^\x20\x09-\x0D]+"
ORDER = ["finish", "rank", "pass", "key", "doc_id", "size"]


def sized(docs: DataFrame, seed: int, carry: list[str]) -> DataFrame:
    """``doc_id, source, size`` (words; null text 0), the shuffle key and the columns to carry."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", "source", words.alias("size"), key.alias("key"), *carry)


def source_targets(sizes: DataFrame, weights: list[int], passes: int) -> DataFrame:
    """Per source: ``rank`` (code point order, null last), ``weight``, ``source_size``, ``before`` (words of the sources before
    it) and ``target``.

    Weights repeat in order of rank and share the words of all sources. A target stops at ``passes`` times its source's
    words; the excess goes to the others by weight. Sources are taken by words over weight: as long as a source's cap is
    not above its share of what the earlier ones leave, it is full. All of that is running totals, so many sources are fine.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(per, ["source"], {"rank": "one", "before": "source_size"})
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int")).cast("long"))
    ranked = ranked.withColumn("before", F.col("before") - F.col("source_size"))
    exact = ranked.withColumn("cap", (F.col("source_size") * passes).cast("decimal(38,0)")).withColumn(
        "ratio", F.col("cap").cast("double") / F.col("weight")
    )
    summed = stage(running_totals(exact, ["ratio", "rank"], {"cap_sum": "cap", "weight_sum": "weight"}), "filling")
    whole = summed.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    filled = summed.crossJoin(F.broadcast(whole)).withColumn(
        "full",
        F.col("cap") * (F.col("all_weight") - F.col("weight_sum") + F.col("weight")).cast("decimal(38,0)")
        <= F.col("weight") * (F.col("all_words") - F.col("cap_sum") + F.col("cap")),
    )
    rest = filled.agg(
        (F.max("all_words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).alias("words_left"),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(1)).alias("weight_left"),
    )
    share = F.col("weight").cast("double") * F.col("words_left").cast("double") / F.col("weight_left").cast("double")
    return filled.crossJoin(F.broadcast(rest)).select(
        "source", "rank", "weight", "source_size", "before",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def mix_sources(
    docs: DataFrame, weights: list[int] | None = None, passes: int = 3, seed: int = 7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, source``; other columns ignored): ``doc_id, source, size, source_size,
    target, taken, copies``, and the columns named by ``carry``, which tell rows with one id apart.

    The budget is the words of all documents. ``taken`` is ``size`` times ``copies``, the passes in which the document lies
    before the cut; no document is taken more than ``passes`` times. Null text has size 0, null sources form the last source,
    null ids share one place in the shuffle, repeated rows count one by one, an empty table gives an empty table. Reruns
    agree: the shuffle is a digest of seed and id. A hot source is no single group: its running words are a running
    total over ranges of the whole table.
    """
    weights, carry = weights or [5, 2, 1], list(carry)
    sizes = stage(sized(docs, seed, carry), "sizes")
    sources = stage(source_targets(sizes, weights, passes), "sources")
    queued = running_total(_with_source(sizes, sources), ["rank", "key", "doc_id", "size", *carry], "size", "sent")
    queued = stage(queued.withColumn("sent", F.col("sent") - F.col("before")).drop("before"), "queue")

    def finish(number):
        return (number.cast("long") * F.col("source_size") + F.col("sent")).cast("double") / F.col("weight")

    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    copies = copies.withColumn("finish", finish(F.col("pass"))).select(*ORDER)
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first()["budget"]
    cut = F.broadcast(cut_at(copies, ORDER, "size", budget).withColumnRenamed("key", "cut"))  # one row
    count = F.lit(0)
    for number in range(passes):
        key = F.struct(*[finish(F.lit(number)) if c == "finish" else F.lit(number) if c == "pass" else F.col(c) for c in ORDER])
        count = count + F.when(F.col("cut").isNotNull() & (key <= F.col("cut")), 1).otherwise(0)
    mixed = queued.join(cut, F.lit(True), "left")
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * count).alias("taken"), count.alias("copies"),
        *carry,
    )


def _with_source(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the figures of their source. Only documents are as many as the table has rows; adaptive execution
    broadcasts the sources while they are small and otherwise splits a hot source's partition."""
    right = sources.withColumnRenamed("source", "__source")
    return sizes.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op5_mixing": op5_mixing}
SQL = {
    "op5_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (rank - 1) % 3] AS weight, 3 * source_size AS cap FROM per
), filling AS (
  SELECT *, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM weighted
), filled AS (
  SELECT *, cap * (all_weight - ws) <= weight * (all_words - caps) AS is_full FROM filling
), rest AS (
  SELECT (max(all_words) - coalesce(sum(cap) FILTER (is_full), 0))::DOUBLE AS words_left,
    coalesce(sum(weight) FILTER (NOT is_full), 1)::DOUBLE AS weight_left FROM filled
), sources AS (
  SELECT source, rank, weight, source_size,
    CASE WHEN is_full THEN cap::DOUBLE ELSE weight::DOUBLE * words_left / weight_left END AS target FROM filled, rest
), queue AS (
  SELECT d.doc_id, d.source, d.size, d.key, s.rank, s.weight, s.source_size, s.target,
    sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), copies AS (
  SELECT q.*, p.pass, (p.pass * source_size + sent)::DOUBLE / weight AS finish FROM queue q, (VALUES (0), (1), (2)) p(pass)
), sorted AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, key, doc_id, size) AS reached FROM copies
)
SELECT doc_id, size, source_size, target,
  (size * count(*) FILTER (reached <= (SELECT sum(size) FROM sizes)))::BIGINT AS taken, source
FROM sorted GROUP BY doc_id, size, source_size, target, source, sent
"""
}
