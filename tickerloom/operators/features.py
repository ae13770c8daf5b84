"""The sixteen model inputs of a daily series, as windows over one ``(symbol, date)`` layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.guards import clip
from tickerloom.operators.returns import series

EPS = 1e-9
HISTORY = 30  # feature rows start once this many earlier rows exist
EMA_BLOCK = 128
EMA_CARRY = 4  # (25/27)**(128*4) is below 1e-17, so older blocks cannot change a double

# Feature order, and how many rows back each lag looks.
FEATURES = [
    "lag1", "lag2", "lag3", "lag5", "lag7", "lag14", "mean7", "mean14", "vol7", "vol14", "macd", "rsi",
    "price_mom", "vol_ratio", "bb_pos", "btc_lag1",
]
LAG_OFFSETS = {"lag1": 0, "lag2": 1, "lag3": 2, "lag5": 4, "lag7": 6, "lag14": 13}


def with_model_return(df: DataFrame, price: str = "close_usd") -> DataFrame:
    """Row number ``i`` within the series and the clipped return ``r`` the models work on."""
    prev = F.lag(price, 1).over(series())
    change = F.try_divide(F.col(price) - F.col("_prev"), F.abs("_prev") + F.lit(EPS))
    return (
        df.withColumns({"i": F.row_number().over(series()) - 1, "_prev": prev})
        .withColumn("r", F.coalesce(clip(change, -0.5, 5.0), F.lit(0.0)))
        .drop("_prev")
    )


def lags() -> dict[str, Column]:
    return {n: (F.lag("r", k).over(series()) if k else F.col("r")) for n, k in LAG_OFFSETS.items()}


def rolling_means() -> dict[str, Column]:
    return {f"mean{n}": F.avg("r").over(series(n)) for n in (7, 14)}


def rolling_deviations() -> dict[str, Column]:
    return {f"vol{n}": F.stddev_pop("r").over(series(n)) + F.lit(EPS) for n in (7, 14)}


def rsi(rows: int = 14) -> Column:
    """Strength index from plain averages of the gains and of the losses in the frame (no smoothing)."""
    frame = series(rows)
    gain = F.coalesce(F.avg(F.when(F.col("r") > 0, F.col("r"))).over(frame), F.lit(0.0))
    loss = F.coalesce(F.avg(F.when(F.col("r") < 0, -F.col("r"))).over(frame), F.lit(EPS))
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss)


def momentum(price: str = "close_usd") -> Column:
    before = F.lag(price, HISTORY).over(series())
    return (F.col(price) - before) / (before + F.lit(EPS))


def volume_ratio(volume: str = "volume_usd") -> Column:
    return F.col(volume) / (F.avg(volume).over(series(7)) + F.lit(EPS))


def band_position(price: str = "close_usd") -> Column:
    frame = series(20)
    width = F.lit(2.0) * (F.stddev_pop(price).over(frame) + F.lit(EPS))
    return (F.col(price) - F.avg(price).over(frame)) / width


def market_lag() -> Column:
    return F.lag("btc_return", 1).over(series())


def with_emas(df: DataFrame, value: str = "r", spans: tuple[int, ...] = (12, 26)) -> DataFrame:
    """Exponential moving averages seeded with the first value, without walking the series row by row.

    The recursion ``e = a*x + (1-a)*e_prev`` is a weighted prefix sum. Rows are cut into blocks of 128 so that the
    powers of ``1-a`` stay in range; each block sums locally, and the end values of the four blocks before it are
    carried in with their decayed weight. Needs the running row number ``i``.
    """
    blocked = df.withColumns(
        {"_blk": F.floor(F.col("i") / F.lit(EMA_BLOCK)), "_j": F.col("i") % F.lit(EMA_BLOCK)}
    )
    within = Window.partitionBy("symbol", "_blk").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.partitionBy("symbol").orderBy("_blk")
    local, whole = {}, {}
    for span in spans:
        a, keep = 2.0 / (span + 1), 1.0 - 2.0 / (span + 1)
        weight = F.when(F.col("i") == 0, F.lit(1.0 / a)).otherwise(F.lit(1.0))
        scaled = F.col(value) * weight * F.pow(F.lit(keep), -F.col("_j"))
        local[f"_p{span}"] = F.lit(a) * F.pow(F.lit(keep), F.col("_j")) * F.sum(scaled).over(within)
        block_end = F.when(F.col("_j") == EMA_BLOCK - 1, F.col(f"_p{span}"))
        carried = F.lit(0.0)
        for q in range(1, EMA_CARRY + 1):
            ended = F.max(block_end).over(by_block.rangeBetween(-q, -q))
            carried = carried + F.coalesce(ended, F.lit(0.0)) * F.lit(keep ** (EMA_BLOCK * (q - 1)))
        whole[f"ema{span}"] = F.col(f"_p{span}") + carried * F.pow(F.lit(keep), F.col("_j") + 1)
    return blocked.withColumns(local).withColumns(whole).drop("_blk", "_j", *local)


def feature_frame(df: DataFrame) -> DataFrame:
    """Add all features and the next row's return and date to every row of a table with at least the columns
    ``symbol, date, close_usd, volume_usd, btc_return``. Every window shares the hash partitioning by symbol, so the
    frame costs one shuffle, and none on top of other windows by symbol."""
    base = with_model_return(df)
    measured = base.withColumns(
        {
            **lags(),
            **rolling_means(),
            **rolling_deviations(),
            "rsi": rsi(),
            "price_mom": momentum(),
            "vol_ratio": volume_ratio(),
            "bb_pos": band_position(),
            "btc_lag1": market_lag(),
            "next_return": F.lead("r", 1).over(series()),
            "next_date": F.lead("date", 1).over(series()),
        }
    )
    return with_emas(measured).withColumn("macd", F.col("ema12") - F.col("ema26"))


def feature_rows(frame: DataFrame) -> DataFrame:
    """Rows that have a full history behind them and a known next day."""
    return frame.filter((F.col("i") >= HISTORY) & F.col("next_date").isNotNull())
