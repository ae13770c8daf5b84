"""Stage tables and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.workspace import fresh_path

__all__ = [
    "fresh_path", "optional_source", "read_matrix_csv", "read_parquet", "write_csv", "write_matrix_csv", "write_parquet",
]


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a table. Partitioned tables are rebalanced first: adaptive execution then splits a partition value
    that owns much of the data over several writers and merges small ones into one file."""
    if partition_by:
        balanced = df.hint("rebalance", *[F.col(c) for c in partition_by])
        balanced.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def optional_source(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at ``path``, or an empty one of the given schema when nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_matrix_csv(wide: DataFrame, path: str) -> None:
    write_csv(wide, path)


def read_matrix_csv(spark: SparkSession, path: str, label: str, columns: list[str]) -> DataFrame:
    """Wide matrix back from CSV: one label column, then numbers."""
    schema = T.StructType(
        [T.StructField(label, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in columns]]
    )
    return spark.read.schema(schema).option("header", "true").csv(path)
