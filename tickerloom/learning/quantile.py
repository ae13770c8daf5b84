"""Boosted quantile regression.

Each round fits a shallow tree to the gradient of the quantile loss over a share of the rows, then sets every leaf to the
quantile of the residuals that fall into it. All quantiles, and all sets of training rows, share the passes.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.learning.boosting import Forest, Growth, Quantiles, fit_forest
from tickerloom.operators.features import FEATURES
from tickerloom.workspace import stage

# Functions that run in tasks travel with them, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class QuantileSettings:
    rounds: int = 150
    step: float = 0.05
    depth: int = 3
    min_leaf: int = 1
    subsample: float = 0.8
    bins: int = 64
    seed: int = 42
    block_days: int = 180

    def growth(self) -> Growth:
        return Growth(self.rounds, self.step, self.depth, self.min_leaf, self.bins)


@dataclass
class QuantileModel:
    """One quantile of one set of a forest."""

    alpha: float
    forest: Forest
    set: int
    output: int

    @property
    def base(self) -> float:
        return float(self.forest.base[self.set, self.output])

    @property
    def rounds(self) -> int:
        return self.forest.feature.shape[2]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forest.scores(x, self.set)[:, self.output]


def pinball(actual: Column, predicted: Column, alpha: float) -> Column:
    """Mean quantile loss (an aggregate)."""
    return F.avg(F.greatest(alpha * (actual - predicted), (1 - alpha) * (predicted - actual)))


def fit_quantile_sets(
    rows: DataFrame,
    masks: list[Column],
    alphas: tuple[float, ...],
    target: str = "next_return",
    settings: QuantileSettings = QuantileSettings(),
) -> Forest:
    """The quantiles ``alphas`` of ``target`` on the sixteen features of ``symbol, date`` rows, for every mask. Rows are drawn
    by a hash of their key, so a recomputed task draws the same ones."""
    loss = Quantiles(alphas, settings.subsample, settings.seed)
    if not masks:
        return fit_forest(rows, 0, loss, settings.growth())
    weights = F.array(*[F.coalesce(mask, F.lit(False)).cast("double") for mask in masks])
    known = rows.filter(F.col(target).isNotNull()).select(
        *FEATURES, F.col(target).alias("y"), F.xxhash64("symbol", "date").alias("draw"), weights.alias("w")
    )
    held = known.filter(F.exists("w", lambda w: w > 0))
    return fit_forest(stage(held, "boosting"), len(masks), loss, settings.growth())


def boost_quantiles(
    train: DataFrame,
    alphas: tuple[float, ...],
    target: str = "next_return",
    settings: QuantileSettings = QuantileSettings(),
) -> list[QuantileModel]:
    """Fit several quantiles of ``target`` on all rows."""
    forest = fit_quantile_sets(train, [F.lit(True)], alphas, target, settings)
    return [QuantileModel(alpha, forest, 0, k) for k, alpha in enumerate(alphas)]


def quantile_boost(
    train: DataFrame, alpha: float, target: str = "next_return", settings: QuantileSettings = QuantileSettings()
) -> QuantileModel:
    """Fit a single quantile."""
    return boost_quantiles(train, (alpha,), target, settings)[0]


def predict_quantile(rows: DataFrame, model: QuantileModel, name: str) -> DataFrame:
    """Add the prediction as a column. All trees are walked at once over batches of rows."""

    @F.pandas_udf("double")
    def predict(*inputs: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.column_stack([i.astype(float) for i in inputs])))

    return rows.withColumn(name, predict(*FEATURES))
