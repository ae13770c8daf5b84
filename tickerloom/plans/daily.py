"""The daily batch run. Every stage is stored once and the next one starts from the stored table, so no stage is
computed twice and a lost executor costs at most the stage being written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.guards import drop_null_keys
from tickerloom.learning.classifier import ClassifierSettings, block_models, fit_sets, generate_signals, split_usable
from tickerloom.learning.forecast import forecast_models, forecast_trend
from tickerloom.learning.quantile import QuantileSettings, fit_quantile_sets
from tickerloom.learning.store import reusing
from tickerloom.learning.walkforward import walk_forward_eval
from tickerloom.operators.bars import BRIDGE_SYMBOL, normalize_usd, quote_side
from tickerloom.operators.contagion import contagion_matrix
from tickerloom.operators.features import feature_frame
from tickerloom.operators.labels import labelled_panel, with_label_inputs
from tickerloom.operators.returns import join_market_factor, market_factor, scored_series, with_returns
from tickerloom.sources.candles import clean_candles
from tickerloom.sources.intake import CandleIntake
from tickerloom.sources.tables import read_parquet, write_parquet
from tickerloom.workspace import settle


@dataclass(frozen=True)
class DailyRun:
    """Locations and settings of a run. Models are kept below the target and used again as long as the rows they were fitted on
    and the settings stay as they are. ``include_next`` also gives the signal for the day after the last bar."""

    target: str
    classifier: ClassifierSettings = field(default_factory=ClassifierSettings)
    quantiles: QuantileSettings = field(default_factory=QuantileSettings)
    include_next: bool = False

    def path(self, table: str) -> str:
        return f"{self.target.rstrip('/')}/{table}"

    def store(self, df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
        write_parquet(df, self.path(table), partition_by)
        return read_parquet(df.sparkSession, self.path(table))

    def bars(self, spark: SparkSession, candles: str) -> DataFrame:
        """Candle files, overlaps removed, stored by quote side. Files taken by an earlier run are not read again."""
        intake = CandleIntake(self.path("intake"))
        intake.take(settle(spark), candles)
        clean = clean_candles(intake.candles(spark))
        return self.store(clean.drop("ignore").withColumn("side", quote_side()), "bars", ["side"])

    def series(self, bars: DataFrame) -> DataFrame:
        """Scores, features, thresholds and labels of every row in one pass: a single shuffle by symbol on the narrow
        USD bars serves all of them, and later stages only filter and project the stored table. It is stored by year,
        so that a trailing window reads only recent files."""
        usd = drop_null_keys(normalize_usd(bars), ("close_usd", "date", "symbol"))
        factor = market_factor(with_returns(usd.filter(F.col("symbol") == BRIDGE_SYMBOL)))
        frame = feature_frame(join_market_factor(scored_series(usd), factor))
        return self.store(with_label_inputs(frame).withColumn("year", F.year("date")), "series", ["year"])

    def signals(self, series: DataFrame, log: list[bool] | None = None) -> DataFrame:
        """``log`` gets whether the models were there already."""
        panel = labelled_panel(series, include_next=self.include_next)
        fit = reusing(fit_sets, self.target, "signals", log)
        models = block_models(split_usable(panel), self.classifier, fit)
        return self.store(generate_signals(panel, self.classifier, models), "signals")

    def forecast(self, series: DataFrame, log: list[bool] | None = None) -> DataFrame:
        """``log`` gets whether the models were there already."""
        models = forecast_models(series, self.quantiles, reusing(fit_quantile_sets, self.target, "forecast", log))
        return self.store(forecast_trend(series, self.quantiles, models=models), "forecast")

    def run(self, spark: SparkSession, candles: str) -> dict[str, DataFrame]:
        """All stages; returns the stored tables by name."""
        series = self.series(self.bars(spark, candles))
        return {
            "series": series,
            "contagion": self.store(contagion_matrix(series), "contagion"),
            "signals": self.signals(series),
            "forecast": self.forecast(series),
        }

    def evaluate(self, series: DataFrame) -> DataFrame:
        return self.store(walk_forward_eval(labelled_panel(series), self.classifier), "metrics")
