"""Returns, rolling volatility and the risk-adjusted score (rows are trading days, gaps are not filled)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.functions.guards import positive_or, ratio
from tickerloom.operators.bars import BRIDGE_SYMBOL

DAYS_PER_YEAR = 365
ANNUAL = math.sqrt(DAYS_PER_YEAR)


def series(last: int | None = None) -> WindowSpec:
    """The symbol's rows in date order; with ``last`` the frame is the current row and those before it."""
    w = Window.partitionBy("symbol").orderBy("date")
    return w if last is None else w.rowsBetween(1 - last, 0)


def change_from(before: Column, now: Column) -> Column:
    return ratio(now - before, before)


def annual_volatility(rows: int) -> Column:
    return F.coalesce(F.stddev_samp("daily_return").over(series(rows)) * F.lit(ANNUAL), F.lit(0.0))


def with_returns(df: DataFrame) -> DataFrame:
    """Previous close, close thirty rows ago and the two returns derived from them."""
    close = F.col("close_usd")
    return df.withColumns(
        {
            "prev_close_usd": F.lag("close_usd", 1).over(series()),
            "close_usd_30d_ago": F.lag("close_usd", 30).over(series()),
            "avg_volume_30d": F.avg("volume_usd").over(series(30)),
        }
    ).withColumns(
        {
            "daily_return": change_from(F.col("prev_close_usd"), close),
            "return_30d": change_from(F.col("close_usd_30d_ago"), close),
        }
    )


def analyze(df: DataFrame) -> DataFrame:
    """USD bars with all rolling measures; one shuffle and one sort serve every window."""
    return with_returns(df).withColumns(
        {"volatility_7d": annual_volatility(7), "volatility_30d": annual_volatility(30)}
    )


def score(df: DataFrame) -> DataFrame:
    return df.withColumn("safe_volatility", positive_or(F.col("volatility_30d"), 1e-9)).withColumn(
        "safety_score", F.col("return_30d") / F.col("safe_volatility")
    )


def scored_series(usd_bars: DataFrame) -> DataFrame:
    return score(analyze(usd_bars))


def market_factor(scored: DataFrame, symbol: str = BRIDGE_SYMBOL) -> DataFrame:
    """Daily return of the market proxy by date, folded to one row per calendar day (the largest where a day is repeated)."""
    own = scored.filter(F.col("symbol") == symbol)
    best = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("daily_return")))  # within the symbol's partition
    return own.select("date", F.col("daily_return").alias("btc_return"), best.alias("_nth")).filter("_nth = 1").drop("_nth")


def join_market_factor(df: DataFrame, factor: DataFrame) -> DataFrame:
    """Left join by date, 0 where the market proxy has no row. The factor is bounded by the calendar."""
    return df.join(F.broadcast(factor), "date", "left").fillna({"btc_return": 0.0})
