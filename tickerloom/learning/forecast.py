"""One-year price cones: three quantile models rolled forward day by day."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.display import exp_decay
from tickerloom.functions.guards import clip
from tickerloom.learning.boosting import Forest
from tickerloom.learning.classifier import block_starts, older_than, set_of_block, with_block
from tickerloom.learning.quantile import QuantileModel, QuantileSettings, fit_quantile_sets
from tickerloom.operators.features import EPS, HISTORY, feature_rows
from tickerloom.operators.returns import series
from tickerloom.operators.selection import MIN_FEATURE_ROWS, MIN_ROWS, with_row_count
from tickerloom.schemas import FORECAST

# Horizon, limit of a daily move, decay of the cone, price floor and the three quantiles.
HORIZON = 365
MAX_STEP = 0.20
DECAY_DAYS = 180.0
PRICE_FLOOR = 1e-9
QUANTILES = (0.10, 0.50, 0.90)

BATCH_SYMBOLS, TASK_SYMBOLS = 500, 50

# The rollout's functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cone_returns(raw_low: Column, middle: Column, raw_high: Column, t: Column) -> tuple[Column, Column, Column]:
    """Outer returns pulled towards the median as time goes on, never crossing it."""
    low, mid, high = (clip(c, -MAX_STEP, MAX_STEP) for c in (raw_low, middle, raw_high))
    fade = exp_decay(t, DECAY_DAYS)
    return F.least(mid, mid + (low - mid) * fade), mid, F.greatest(mid, mid + (high - mid) * fade)


def compound(df: DataFrame, returns: str, start: str, name: str) -> DataFrame:
    """Logarithm of the compounded price with a floor under every step, without stepping through the rows.

    ``p = max(p_prev * (1 + r), floor)`` is a random walk in logs that is pushed up at the floor. Its value is the
    running sum plus the larger of the start and the largest push needed so far.
    """
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_s", F.sum(F.log1p(returns)).over(so_far))
    push = F.max(F.lit(float(np.log(PRICE_FLOOR))) - F.col("_s")).over(so_far)
    return summed.withColumn("_m", push).withColumn(
        name, F.col("_s") + F.greatest(F.ln(start), F.col("_m"))
    ).drop("_s", "_m")


def forecast_cone(df: DataFrame) -> DataFrame:
    """Log price chains for given raw quantile returns ``q10, q50, q90``, step ``t`` and start price ``start``."""
    low, mid, high = cone_returns(F.col("q10"), F.col("q50"), F.col("q90"), F.col("t"))
    faded = df.withColumns({"_r10": low, "_r50": mid, "_r90": high})
    for q in ("10", "50", "90"):
        faded = compound(faded, f"_r{q}", "start", f"ln_p{q}")
    return faded.drop("_r10", "_r50", "_r90")


def rollout_state(frame: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """What the rollout needs of each series: its last 31 returns and prices and a few values of its last row.

    The frame is already partitioned by symbol, so neither the window nor the grouping shuffles it again.
    """
    counted = with_row_count(frame)
    long_enough = counted.filter(
        (F.col("n_rows") >= max(min_rows, HISTORY + 1 + MIN_FEATURE_ROWS)) & (F.col("i") >= F.col("n_rows") - HISTORY - 1)
    )
    recent = F.array_sort(F.collect_list(F.struct("i", "r", "close_usd")))  # 31 entries
    last = F.max_by(F.struct("date", "ema12", "ema26", "vol_ratio", "bb_pos", "btc_lag1"), "i")
    return (
        long_enough.groupBy("symbol")
        .agg(recent.alias("_w"), last.alias("_l"))
        .select(
            "symbol",
            F.transform("_w", lambda x: x["r"]).alias("returns"),
            F.transform("_w", lambda x: x["close_usd"]).alias("prices"),
            "_l.*",
        )
    )


def _current_features(r: np.ndarray, p: np.ndarray, macd: np.ndarray, frozen: np.ndarray) -> np.ndarray:
    """The sixteen inputs after the newest return, by the same definitions the training frame uses."""
    w7, w14 = r[:, -7:], r[:, -14:]
    ups, downs = w14 > 0, w14 < 0
    gain = np.where(ups, w14, 0.0).sum(axis=1) / np.maximum(ups.sum(axis=1), 1)
    loss = np.where(downs.any(axis=1), -np.where(downs, w14, 0.0).sum(axis=1) / np.maximum(downs.sum(axis=1), 1), EPS)
    columns = [r[:, -1 - k] for k in (0, 1, 2, 4, 6, 13)]
    columns += [w7.mean(axis=1), w14.mean(axis=1), w7.std(axis=1) + EPS, w14.std(axis=1) + EPS, macd]
    columns += [100.0 - 100.0 / (1.0 + gain / loss), (p[:, -1] - p[:, 0]) / (p[:, 0] + EPS)]
    return np.column_stack([*columns, frozen])


def _roll(forest: Forest, horizon: int):
    a12, a26 = 2.0 / 13, 2.0 / 27

    def paths(state: pd.DataFrame, number: int) -> np.ndarray:
        r, p = np.vstack(state["returns"].to_list()), np.vstack(state["prices"].to_list())
        e12, e26 = state["ema12"].to_numpy(float), state["ema26"].to_numpy(float)
        frozen = state[["vol_ratio", "bb_pos", "btc_lag1"]].to_numpy(float)
        chain = np.repeat(p[:, -1:], 3, axis=1)
        out = np.empty((len(state), horizon, 3))
        for t in range(horizon):
            raw = np.clip(forest.scores(_current_features(r, p, e12 - e26, frozen), number), -MAX_STEP, MAX_STEP)
            mid, fade = raw[:, 1], np.exp(-t / DECAY_DAYS)
            low = np.minimum(mid, mid + (raw[:, 0] - mid) * fade)
            high = np.maximum(mid, mid + (raw[:, 2] - mid) * fade)
            chain = np.maximum(chain * (1.0 + np.column_stack([low, mid, high])), PRICE_FLOOR)
            out[:, t] = chain
            r = np.column_stack([r[:, 1:], mid])
            p = np.column_stack([p[:, 1:], chain[:, 1]])
            e12, e26 = a12 * mid + (1 - a12) * e12, a26 * mid + (1 - a26) * e26
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [
                (number, rows.iloc[start : start + BATCH_SYMBOLS])
                for number, rows in batch.groupby("set")
                for start in range(0, len(rows), BATCH_SYMBOLS)
            ]
            for number, state in parts:
                chains = paths(state, int(number)).reshape(-1, 3)
                days = np.tile(np.arange(1, horizon + 1), len(state)).astype("timedelta64[D]")
                first = np.repeat(state["date"].to_numpy("datetime64[D]"), horizon)
                yield pd.DataFrame(
                    {
                        "symbol": np.repeat(state["symbol"].to_numpy(), horizon),
                        "date": pd.Series(first + days).dt.date,
                        "predicted_p10": chains[:, 0],
                        "predicted_p50": chains[:, 1],
                        "predicted_p90": chains[:, 2],
                        "predicted_close": chains[:, 1],
                    }
                )

    return run


def recursive_rollout(
    frame: DataFrame, models: list[QuantileModel] | Forest, horizon: int = HORIZON, sets: DataFrame | None = None
) -> DataFrame:
    """Daily cones after the last row of every series, by three quantile models, or by a forest of which ``sets`` names the set
    of each ``symbol``; series without a set get no cone.

    Steps follow each other in time, so this part runs in Python; a batch of series advances together as matrices
    and only the 31-row state is shipped. The state is dealt by work, ``TASK_SYMBOLS`` series a task, since its bytes
    are few and adaptive execution would merge them into one.
    """
    state = rollout_state(frame)
    if sets is None:
        forest, state = models[0].forest, state.withColumn("set", F.lit(models[0].set))
    else:
        forest, state = models, state.join(sets, "symbol")
    tasks = max(1, -(-frame.select("symbol").distinct().count() // TASK_SYMBOLS))
    return state.repartition(tasks, "symbol").mapInPandas(_roll(forest, horizon), FORECAST)


@dataclass
class ForecastModels:
    """Quantile models by the calendar block in which a series ends."""

    starts: list[date]
    forest: Forest


def forecast_rows(frame: DataFrame) -> DataFrame:
    """Feature rows of the series that are long enough."""
    return feature_rows(with_row_count(frame).filter(F.col("n_rows") >= MIN_ROWS))


def last_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.max("date").alias("next_date"))


def forecast_models(
    frame: DataFrame,
    settings: QuantileSettings = QuantileSettings(),
    fit: Callable[..., Forest] = fit_quantile_sets,
) -> ForecastModels:
    """Models of every block in which a series ends, each fitted on all rows of the panel older than the block, all in the
    same passes. ``fit`` may return a stored forest."""
    rows = forecast_rows(frame)
    starts = block_starts(last_days(rows), settings.block_days)
    return ForecastModels(starts, fit(rows, [older_than(s) for s in starts], QUANTILES, settings=settings))


def series_sets(frame: DataFrame, models: ForecastModels, settings: QuantileSettings) -> DataFrame:
    """``symbol, set`` of every long enough series; ``set`` is null where nothing older than its block was there to learn from."""
    blocks = with_block(last_days(forecast_rows(frame)), settings.block_days)
    fitted = F.array(*[F.lit(bool(f)) for f in models.forest.fitted]).cast("array<boolean>")
    number = set_of_block(models.starts).cast("int")
    return blocks.select("symbol", F.when(F.get(fitted, number), number).alias("set"))


def forecast_trend(
    frame: DataFrame,
    settings: QuantileSettings = QuantileSettings(),
    horizon: int = HORIZON,
    models: ForecastModels | None = None,
) -> DataFrame:
    """Fit the three quantile models and roll every series forward. The frame should be a stored table.

    Series are taken by the calendar block their last day lies in, and each block's models are fitted on all rows of the
    panel older than it. Series that are too short, or whose block has no older rows, get no cone; ``series_sets`` names the
    latter.
    """
    models = models or forecast_models(frame, settings)
    sets = series_sets(frame, models, settings).filter("set is not null")
    return recursive_rollout(frame, models.forest, horizon, sets)
