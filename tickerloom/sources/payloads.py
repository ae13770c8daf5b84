"""Feed payloads (JSON text) to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.calendar import millis_to_timestamp
from tickerloom.functions.display import array_field, hot_flag, vote_sentiment
from tickerloom.schemas import MARKET_NAMES, MARKET_RECORD

GLOBAL = (
    "data struct<total_market_cap: struct<usd: double>, total_volume: struct<usd: double>, "
    "market_cap_percentage: struct<btc: double, eth: double>, active_cryptocurrencies: bigint, "
    "market_cap_change_percentage_24h_usd: double>"
)
INDEX = "data array<struct<value: string, value_classification: string, timestamp: string>>"
HISTORY = "prices array<array<double>>, total_volumes array<array<double>>"
CANDLES = "array<array<string>>"
NEWS = (
    "results array<struct<title: string, url: string, source: struct<title: string>, published_at: string, "
    "currencies: array<struct<code: string>>, votes: struct<positive: int, negative: int, important: int>>>"
)
NEUTRAL_INDEX = (50, "Neutral")  # fixed value: shown when the index is unavailable
CANDLE_FIELDS = 6  # fixed value: shortest usable candle row


def others(df: DataFrame, column: str) -> list[str]:
    return [c for c in df.columns if c != column]


def market_records(df: DataFrame, column: str) -> DataFrame:
    """Array of listings to one row each, under the engine's names; fields a feed leaves out are null."""
    rows = df.select(F.inline(F.from_json(column, MARKET_RECORD)))
    return rows.withColumnsRenamed(MARKET_NAMES)


def global_stats(df: DataFrame, column: str) -> DataFrame:
    """Market-wide numbers from a two-level object, 0 for whatever is missing."""
    parsed = df.withColumn("_g", F.from_json(column, GLOBAL)["data"])

    def number(path: str, name: str) -> Column:
        return F.coalesce(F.col(f"_g.{path}"), F.lit(0)).alias(name)

    return parsed.select(
        *others(df, column),
        number("total_market_cap.usd", "total_market_cap"),
        number("total_volume.usd", "total_volume_24h"),
        number("market_cap_percentage.btc", "btc_dominance"),
        number("market_cap_percentage.eth", "eth_dominance"),
        number("active_cryptocurrencies", "active_coins"),
        number("market_cap_change_percentage_24h_usd", "market_cap_change_24h"),
    )


def sentiment_index(df: DataFrame, column: str) -> DataFrame:
    """Newest index value with its label, and the list of earlier ones."""
    data = F.from_json(column, INDEX)["data"]
    value, label = NEUTRAL_INDEX
    newest = F.try_element_at("_d", F.lit(1))
    history = F.transform(
        "_d",
        lambda d: F.struct(
            d["value"].try_cast("int").alias("value"),
            d["value_classification"].alias("label"),
            d["timestamp"].alias("timestamp"),
        ),
    )
    return df.withColumn("_d", data).select(
        *others(df, column),
        F.coalesce(newest["value"].try_cast("int"), F.lit(value)).alias("value"),
        F.coalesce(newest["value_classification"], F.lit(label)).alias("label"),
        F.coalesce(newest["timestamp"], F.lit("")).alias("timestamp"),
        F.coalesce(history, F.array().cast("array<struct<value:int,label:string,timestamp:string>>")).alias("history"),
    )


def parallel_history(df: DataFrame, column: str) -> DataFrame:
    """Aligned ``[time, price]`` and ``[time, volume]`` arrays to rows; volumes count only if there are as many."""
    parsed = df.withColumn("_h", F.from_json(column, HISTORY))
    prices, volumes = F.col("_h.prices"), F.col("_h.total_volumes")
    aligned = F.when(F.size(prices) == F.size(volumes), volumes)
    rows = F.inline(F.arrays_zip(prices.alias("p"), F.coalesce(aligned, F.array().cast("array<array<double>>")).alias("v")))
    return parsed.select(*others(df, column), rows.alias("p", "v")).select(
        *others(df, column),
        millis_to_timestamp(F.col("p")[0]).alias("date"),
        F.col("p")[1].alias("price"),
        F.col("v")[1].alias("volume"),
    )


def positional_candles(df: DataFrame, column: str) -> DataFrame:
    """Positional candle rows to date, closing price and volume; shorter rows are left out."""
    rows = df.select(*others(df, column), F.explode(F.from_json(column, CANDLES)).alias("_c"))
    return rows.filter(F.size("_c") >= CANDLE_FIELDS).select(
        *others(df, column),
        millis_to_timestamp(F.col("_c")[0]).alias("date"),
        F.col("_c")[4].try_cast("double").alias("price"),
        F.col("_c")[5].try_cast("double").alias("volume"),
    )


def news_articles(df: DataFrame, column: str) -> DataFrame:
    rows = df.select(F.inline(F.from_json(column, NEWS)["results"]))
    return rows.select(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("#")).alias("url"),
        F.coalesce(F.col("source.title"), F.lit("Unknown")).alias("source"),
        F.coalesce("published_at", F.lit("")).alias("published_at"),
        F.coalesce(array_field(F.col("currencies"), "code"), F.array().cast("array<string>")).alias("currencies"),
        vote_sentiment(F.col("votes.positive"), F.col("votes.negative")).alias("sentiment"),
        hot_flag(F.col("votes.important")).alias("is_hot"),
    )


def source_fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All rows of the primary source, and the secondary's rows for keys the primary has nothing for."""
    missing = secondary.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(missing.select(*primary.columns))
