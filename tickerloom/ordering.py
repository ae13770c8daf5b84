"""Running totals over a whole table without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.workspace import stage

PART, BEFORE = "__range", "__before"


def range_sorted(df: DataFrame, order: list[str], name: str = "ranges") -> DataFrame:
    """``df`` stored in range partitions by ``order``, with the partition's number in ``__range``.

    Sampling picks new bounds on each run, so the numbers are kept with the rows. ``order`` should end in columns that
    tell rows apart: equal keys stay in one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in order])
    return stage(ranged.withColumn(PART, F.spark_partition_id()), name)


def range_offsets(ranged: DataFrame, value: str) -> DataFrame:
    """Per range: its total and the total of all ranges before it. One row per range, so the window is small."""
    totals = ranged.groupBy(PART).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(PART, "total", F.coalesce(F.sum("total").over(before), F.lit(0)).alias(BEFORE))


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with a column per entry ``name: value`` of ``sums``: the sum of ``value`` over this and all earlier rows in ``order``
    (nulls last, null values count as 0). One range sort serves all of them."""
    ranged = range_sorted(df, order)
    within = Window.partitionBy(PART).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    within = within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    before = {name: f"{BEFORE}{k}" for k, name in enumerate(sums)}
    totals = ranged.groupBy(PART).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(before[n]) for n, v in sums.items()])
    offsets = totals.select(PART, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in before.values()])
    summed = ranged.withColumns(
        {n: F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in sums.items()}
    ).join(F.broadcast(offsets), PART)
    return summed.withColumns({n: F.col(n) + F.col(before[n]) for n in sums}).drop(PART, *before.values())


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over this and all earlier rows in ``order`` (nulls last)."""
    return running_totals(df, order, {name: value})


def cut_at(df: DataFrame, order: list[str], value: str, budget: Column | int) -> DataFrame:
    """One row with the key (struct ``key`` of ``order``) of the last row that lies within ``budget`` when rows are taken in
    ``order``; rows with one key are taken together. No row when not even the first fits.

    Only the range in which the budget ends is sorted.
    """
    ranged = range_sorted(df, order)
    offsets = range_offsets(ranged, value)
    ends = offsets.filter(F.col(BEFORE) <= budget).agg(F.max(PART).alias(PART))
    last = ranged.join(F.broadcast(ends), PART)
    keys = last.groupBy(PART, F.struct(*order).alias("key")).agg(F.sum(value).alias("amount"))
    within = Window.partitionBy(PART).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    reached = keys.withColumn("reached", F.sum("amount").over(within)).join(F.broadcast(offsets), PART)
    fitting = reached.filter(F.col(BEFORE) + F.col("reached") <= budget).select("key")
    earlier = ranged.join(F.broadcast(ends.withColumnRenamed(PART, "__end")), F.col(PART) < F.col("__end"))
    return fitting.unionByName(earlier.select(F.struct(*order).alias("key"))).agg(F.max("key").alias("key")).filter(
        "key is not null"
    )
