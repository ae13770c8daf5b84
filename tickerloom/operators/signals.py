"""Views over generated signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.display import signal_text
from tickerloom.operators.selection import at_latest_date


def latest_signals(signals: DataFrame) -> DataFrame:
    """Signals of the newest date, likeliest rise first. Symbols whose series ended earlier are not shown."""
    return at_latest_date(signals).orderBy(F.desc("prob_up"), F.asc("symbol"))


def signal_counts(signals: DataFrame) -> DataFrame:
    return at_latest_date(signals).agg(
        *[F.count_if(F.col("signal") == c).alias(f"n_{c.lower()}") for c in ("UP", "DOWN", "NEUTRAL")]
    )


def signal_history(signals: DataFrame, symbol: str) -> DataFrame:
    return signals.filter(F.col("symbol") == symbol).orderBy("date")


def signal_roster(signals: DataFrame) -> DataFrame:
    """Every symbol's own newest signal as BUY, SELL or HOLD with the probability behind it."""
    newest = F.max_by(F.struct("signal", "prob_up", "prob_down", "prob_neutral"), "date")
    return (
        signals.groupBy("symbol")
        .agg(F.max("date").alias("date"), newest.alias("_s"))
        .select(
            "symbol",
            "date",
            signal_text(F.col("_s.signal")).alias("signal"),
            F.greatest("_s.prob_up", "_s.prob_down", "_s.prob_neutral").alias("confidence"),
        )
    )
