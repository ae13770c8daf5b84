"""Cleaning raw bars and expressing them in one currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.schemas import USD_BAR_COLUMNS

USD_SUFFIX = "USDT"
BRIDGE_SUFFIX = "BTC"
BRIDGE_SYMBOL = "BTCUSDT"


def dedup_key(df: DataFrame, order: list[Column], keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """One row per key: the first in ``order``.

    Written as a ``min_by`` aggregation rather than a ranking window, so each map task already reduces a group of
    copies to a single row and a key that owns a large part of the input does not end up in one task.
    """
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def candle_order(path: str = "file_path") -> list[Column]:
    """Preference between overlapping files: daily before monthly, then by path, then by content."""
    is_daily = F.col(path).contains("/daily/")
    return [
        F.when(is_daily, 0).otherwise(1).alias("_rank"),
        F.col(path).alias("_path"),
        F.col("open_time").alias("_time"),
        F.col("close").alias("_close"),
        F.col("volume").alias("_volume"),
    ]


def is_usd() -> Column:
    return F.col("symbol").endswith(USD_SUFFIX)


def quote_side() -> Column:
    """``usd`` or ``other``. A bar table stored under this partition column lets both branches of the conversion
    read disjoint files, which a suffix test on the symbol cannot."""
    return F.when(is_usd(), F.lit("usd")).otherwise(F.lit("other"))


def usd_side(bars: DataFrame) -> DataFrame:
    return bars.filter(is_usd() if "side" not in bars.columns else F.col("side") == "usd")


def other_side(bars: DataFrame) -> DataFrame:
    return bars.filter(~is_usd() if "side" not in bars.columns else F.col("side") == "other")


def base_asset(suffix: str) -> Column:
    return F.expr(f"left(symbol, length(symbol) - {len(suffix)})")


def bridge_prices(bars: DataFrame) -> DataFrame:
    """Price of the bridge asset by date. Folded to one row per calendar day, hence safe to broadcast at any scale and
    harmless where overlapping bars repeat a day (the largest price counts)."""
    own = usd_side(bars).filter(F.col("symbol") == BRIDGE_SYMBOL)
    return own.groupBy("date").agg(F.max("close").alias("btc_usd_price"))


def without_usd_pair(bars: DataFrame, match: str = "base", convert_all: bool = False) -> DataFrame:
    """Rows quoted in the bridge asset whose base asset has no USD series of its own.

    ``match="symbol"`` compares whole symbols (which can never be equal) and ``convert_all=True`` takes every
    non-USD quote for a bridge quote; both exist only to reproduce the looser historical behaviour.
    """
    other = other_side(bars)
    if not convert_all:
        other = other.filter(F.col("symbol").endswith(BRIDGE_SUFFIX))
    if match == "symbol":
        usd_symbols = usd_side(bars).select("symbol").distinct()
        return other.join(usd_symbols, "symbol", "left_anti").select(*bars.columns)
    usd_bases = usd_side(bars).select(base_asset(USD_SUFFIX).alias("_base")).distinct()
    keyed = other.withColumn("_base", base_asset(BRIDGE_SUFFIX))
    return keyed.join(usd_bases, "_base", "left_anti").select(*bars.columns)


def bridge_convert(bars: DataFrame, bridge: DataFrame) -> DataFrame:
    """Multiply price and volume by the bridge price of the day; days without one drop out."""
    price = F.col("btc_usd_price")
    return bars.join(F.broadcast(bridge), "date", "inner").select(
        *bars.columns,
        (F.col("close") * price).alias("close_usd"),
        (F.col("volume") * price).alias("volume_usd"),
    )


def normalize_usd(bars: DataFrame, match: str = "base", convert_all: bool = False) -> DataFrame:
    """All series in USD. Expects one row per ``(symbol, date)``.

    The two branches are told apart by the symbol's suffix, so the union keeps the key unique and needs no further
    duplicate removal.
    """
    native = usd_side(bars).withColumns({"close_usd": F.col("close"), "volume_usd": F.col("volume")})
    converted = bridge_convert(without_usd_pair(bars, match, convert_all), bridge_prices(bars))
    return union_usd(native, converted)


def union_usd(native: DataFrame, converted: DataFrame) -> DataFrame:
    return native.select(*USD_BAR_COLUMNS).unionByName(converted.select(*USD_BAR_COLUMNS))
