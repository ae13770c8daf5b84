"""Derived tables the queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tickerloom.learning.classifier import ClassifierSettings, generate_signals
from tickerloom.learning.forecast import forecast_trend
from tickerloom.learning.quantile import QuantileSettings
from tickerloom.operators.bars import normalize_usd
from tickerloom.operators.evaluation import fold_metrics, symbol_metrics
from tickerloom.operators.features import feature_frame, with_model_return
from tickerloom.operators.labels import labelled_panel, persistence_prediction, walk_forward_folds
from tickerloom.operators.returns import analyze, join_market_factor, market_factor, scored_series
from tickerloom.sources import star
from tickerloom.workspace import fresh_path, settle, stage

_STORED: dict[tuple[str, str, str], str] = {}
_REGISTRIES: dict[str, str] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table of a folder, written once per application and read from the shared folder after that."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key in _STORED:
        try:
            return settle(spark).read.parquet(_STORED[key])
        except AnalysisException:  # the stored copy is gone
            del _STORED[key]
    path = fresh_path(spark, name)
    build().write.parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "bars", lambda: star.bars(spark, folder))


def bars_with_twins(spark: SparkSession, folder: str) -> DataFrame:
    return star.with_twins(bars(spark, folder))


def usd_bars(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_usd(bars(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return scored_series(usd_bars(spark, folder))


def panel_input(spark: SparkSession, folder: str) -> DataFrame:
    usd = usd_bars(spark, folder)
    return join_market_factor(usd, market_factor(analyze(usd)))


def returns(spark: SparkSession, folder: str) -> DataFrame:
    return with_model_return(panel_input(spark, folder))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_frame(panel_input(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_panel(features(spark, folder))


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    return persistence_prediction(labelled(spark, folder))


def folded(spark: SparkSession, folder: str) -> DataFrame:
    return walk_forward_folds(predicted(spark, folder))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    panel = stage(predicted(spark, folder), "predicted")
    return stage(symbol_metrics(fold_metrics(walk_forward_folds(panel)), panel), "metrics")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return stage(generate_signals(stage(labelled(spark, folder), "panel"), ClassifierSettings()), "signals")


def generated(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of the fitted models, generated once per application and viewed from there."""
    return stored(spark, folder, "generated", lambda: signals(spark, folder))


def registry(spark: SparkSession) -> str:
    """Folder of the application's fitted models. A model is found again by its rows and settings alone."""
    return _REGISTRIES.setdefault(spark.sparkContext.applicationId, fresh_path(spark, "registry"))


def forecast(spark: SparkSession, folder: str) -> DataFrame:
    return stage(forecast_trend(stage(features(spark, folder), "features"), QuantileSettings()), "forecast")
