"""Fixed schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of a headerless candle file.
CANDLE_FILE = T.StructType(
    [
        T.StructField("open_time", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("close_time", T.LongType()),
        T.StructField("quote_asset_volume", T.DoubleType()),
        T.StructField("number_of_trades", T.LongType()),
        T.StructField("taker_buy_base_asset_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_asset_volume", T.DoubleType()),
        T.StructField("ignore", T.StringType()),
    ]
)

USD_BAR_COLUMNS = ["date", "symbol", "close", "volume", "close_usd", "volume_usd"]

# The columns of a forecast.
FORECAST = (
    "symbol string, date date, predicted_p10 double, predicted_p50 double, "
    "predicted_p90 double, predicted_close double"
)

# The record layout of a market listing and the names the engine gives its fields.
MARKET_RECORD = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("symbol", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("current_price", T.DoubleType()),
            T.StructField("market_cap", T.DoubleType()),
            T.StructField("total_volume", T.DoubleType()),
            T.StructField("price_change_percentage_24h", T.DoubleType()),
            T.StructField("price_change_percentage_1h_in_currency", T.DoubleType()),
            T.StructField("price_change_percentage_7d_in_currency", T.DoubleType()),
            T.StructField("market_cap_rank", T.LongType()),
            T.StructField("image", T.StringType()),
            T.StructField("sparkline_in_7d", T.StructType([T.StructField("price", T.ArrayType(T.DoubleType()))])),
            T.StructField("ath", T.DoubleType()),
            T.StructField("ath_change_percentage", T.DoubleType()),
            T.StructField("circulating_supply", T.DoubleType()),
        ]
    )
)

MARKET_NAMES = {
    "id": "coin_id",
    "current_price": "price_usd",
    "total_volume": "volume_24h",
    "price_change_percentage_24h": "change_24h",
    "price_change_percentage_1h_in_currency": "change_1h",
    "price_change_percentage_7d_in_currency": "change_7d",
    "market_cap_rank": "rank",
    "image": "image_url",
    "sparkline_in_7d": "sparkline",
    "ath_change_percentage": "ath_change_pct",
}
