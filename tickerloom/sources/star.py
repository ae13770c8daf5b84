"""Daily bars and feed-like tables shaped from a star schema of orders, parts, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.workspace import settle, stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{folder}/{name}.parquet")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per brand and shipping day; brands 1-20 are USD series, 21-25 are quoted in the bridge asset.

    Sums, extremes and the first and last order are plain numbers, so they are added up in hash tables of a row per bar
    before anything is shuffled or sorted. First and last trade are then picked by ``min_by``/``max_by`` on the full sort key
    among the trades of these two orders alone: that aggregation sorts its rows, which all trades of a task would be too many for.
    """
    trades = table(spark, folder, "lineitem").join(
        table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    when = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    priced = trades.select(
        F.expr("cast(substr(p_brand, 7) as int)").alias("n"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.sqrt(F.sqrt(F.col("l_extendedprice") / F.col("l_quantity"))).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("amt"),
        when.alias("seq"),
    )
    n = F.col("n").cast("string")
    symbol = (
        F.when(F.col("n") == 1, F.lit("BTCUSDT"))
        .when(F.col("n") <= 20, F.concat(F.lit("B"), n, F.lit("USDT")))
        .otherwise(F.concat(F.lit("B"), n, F.lit("BTC")))
    )
    order = F.col("seq.l_orderkey")
    summed = stage(
        priced.groupBy("n", "date").agg(
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.sum("qty").alias("volume"),
            F.round(F.sum("amt"), 2).alias("quote_asset_volume"),
            F.count(F.lit(1)).alias("number_of_trades"),
            F.when(F.count(order) == F.count(F.lit(1)), F.min(order)).alias("first"),  # an order without a key comes first
            F.max(order).alias("last"),
        ),
        "summed",
    )
    bounds = summed.select(F.col("n").alias("_n"), F.col("date").alias("_date"), "first", "last")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("date").eqNullSafe(F.col("_date"))
    ends = priced.join(bounds, same & (order.eqNullSafe(F.col("first")) | order.eqNullSafe(F.col("last"))))
    ends = ends.groupBy("_n", "_date").agg(F.min_by("px", "seq").alias("open"), F.max_by("px", "seq").alias("close"))
    return summed.join(ends, same).select(
        symbol.alias("symbol"), "date", "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades"
    )


def with_twins(all_bars: DataFrame) -> DataFrame:
    """Bars plus bridge-quoted copies of three USD series, which a conversion has to leave out."""
    twins = all_bars.filter(F.col("symbol").isin("B2USDT", "B3USDT", "B4USDT")).withColumn(
        "symbol", F.regexp_replace("symbol", "USDT$", "BTC")
    )
    return all_bars.unionByName(twins)
