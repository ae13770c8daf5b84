"""A training corpus from raw documents: toxic documents go, repeated lines go, one of each group of near-copies stays,
benchmark leaks go, and sources are mixed to target weights.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last keep the columns of ``documents``. Between
stages a table is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.decontamination import drop_overlapping
from tickerloom.llm.hyperminhash import NearSettings, near_duplicates
from tickerloom.llm.line_dedup import WHOLE, dedup_lines
from tickerloom.llm.mixing import mix_sources
from tickerloom.llm.toxicity import learn_lexicon, score_toxicity, training_rows
from tickerloom.workspace import stage

#: Five-word shingles, similarity 0.8 or more.
NEAR = NearSettings(words=5, percent=80, bands=40, rows=4)
TOXIC = 0.5


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores put after it until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the lexicon is learned from labelled documents of the table itself."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free_name(docs, "__score")
    scored = score_toxicity(docs, learn_lexicon(training_rows(docs, labels)), score)
    return scored.filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier place has, too; every document stays, ``n_chars`` follows the text."""
    done = dedup_lines(docs, WHOLE)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return done.select(*[chars if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-copies, and all documents without one."""
    dropped = near_duplicates(docs, NEAR).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the benchmark."""
    return drop_overlapping(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, numbered by ``pass`` (a column of that name is replaced); documents left
    out have no row.

    Rows are told apart by two 64-bit hashes of all their columns, so rows that share an id, or have none, are taken each as
    the mix says. Equal rows stand for one another and are numbered together.
    """
    columns = [c for c in docs.columns if c != "pass"]
    first, second = free_name(docs, "__first"), free_name(docs, "__second")
    row = [*columns, *[F.col(c).isNull() for c in columns]]  # a hash alone passes over nulls
    named = docs.select(*columns, F.xxhash64(*row).alias(first), F.xxhash64(F.lit(1), *row[::-1]).alias(second))
    copies = free_name(named, "__copies")
    taken = mix_sources(named, carry=(first, second)).groupBy(first, second).agg(F.sum("copies").alias(copies))
    mixed = named.dropDuplicates([first, second]).join(taken.filter(F.col(copies) > 0), [first, second])
    return mixed.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("pass"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The toxicity lexicon is learned, which SQL cannot state; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
