"""Row selection: trailing window, latest day, history coverage and series quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MIN_ROWS = 180
MIN_VARIATION = 0.10
MIN_FEATURE_ROWS = 30
MIN_LABELS = 2


def max_date(df: DataFrame) -> DataFrame:
    return df.agg(F.max("date").alias("max_date"))


def trailing_days(df: DataFrame, days: int = 30) -> DataFrame:
    """Rows dated at most ``days`` before the latest date, so ``days + 1`` calendar dates in all.

    The latest date is a scalar subquery: nothing is collected and the comparison reaches a date-partitioned scan. A
    table with a column ``year`` is also filtered by it, so that one partitioned by year opens only recent files.
    """
    first = F.date_sub(max_date(df).scalar(), days)
    recent = df.filter(F.col("date") >= first)
    return recent.filter(F.col("year") >= F.year(first)) if "year" in df.columns else recent


def at_latest_date(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date") == max_date(df).scalar())


def coverage(df: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Days per symbol, for symbols present on at least ``min_coverage`` of all dates."""
    all_days = df.agg(F.count_distinct("date")).scalar()
    return (
        df.groupBy("symbol")
        .agg(F.count("date").alias("n_days"))
        .filter(F.col("n_days") >= F.lit(min_coverage) * all_days)
    )


def semi_join_coverage(rows: DataFrame, covered: DataFrame) -> DataFrame:
    return rows.join(covered.select("symbol"), "symbol", "left_semi")


def variation(price: str = "close_usd", over: WindowSpec | None = None) -> Column:
    """Coefficient of variation, population form; an aggregate, or a window measure when ``over`` is given."""
    spread, level = F.stddev_pop(price), F.avg(F.abs(price))
    if over is not None:
        spread, level = spread.over(over), level.over(over)
    return spread / (level + F.lit(1e-9))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct symbols and dates, exact or from sketches."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count("symbol").alias("n_symbols"), count("date").alias("n_dates"))


def series_variation(df: DataFrame, price: str = "close_usd") -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), variation(price).alias("cv"))


def with_row_count(df: DataFrame) -> DataFrame:
    """Length of the own series as ``n_rows``, unless the table has it already."""
    if "n_rows" in df.columns:
        return df
    return df.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def with_series_quality(df: DataFrame, price: str = "close_usd") -> DataFrame:
    """Row count and variation of the own series on every row.

    Windows instead of an aggregate joined back: the input is not computed twice, and the partitioning by symbol
    is the one the following window operators need anyway.
    """
    own = Window.partitionBy("symbol")
    return df.withColumns({"n_rows": F.count(F.lit(1)).over(own), "cv": variation(price, own)})


def series_quality_gate(
    df: DataFrame, min_rows: int = MIN_ROWS, min_variation: float | None = MIN_VARIATION
) -> DataFrame:
    """Keep series that are long enough and, unless ``min_variation`` is None, move enough."""
    good = with_series_quality(df).filter(F.col("n_rows") >= min_rows)
    if min_variation is not None:
        good = good.filter(F.col("cv") >= min_variation)
    return good.select(*df.columns)


def usable_rows_gate(
    labelled: DataFrame, min_rows: int = MIN_FEATURE_ROWS, min_labels: int = MIN_LABELS
) -> DataFrame:
    """Keep series with enough feature rows and enough different labels; a panel usually carries both numbers."""
    if {"n", "n_labels"} <= set(labelled.columns):
        return labelled.filter((F.col("n") >= min_rows) & (F.col("n_labels") >= min_labels))
    own = Window.partitionBy("symbol")
    counted = labelled.withColumns(
        {"_n": F.count(F.lit(1)).over(own), "_k": F.size(F.collect_set("label").over(own))}
    )
    return counted.filter((F.col("_n") >= min_rows) & (F.col("_k") >= min_labels)).drop("_n", "_k")
