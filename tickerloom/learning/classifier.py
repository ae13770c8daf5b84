"""Direction classifier: boosted trees for three classes over the whole panel of series.

All inputs are scale-free and labels use each symbol's own thresholds, so one model serves every symbol and the fit is a
distributed job instead of one local fit per symbol. Models of all calendar blocks are fitted together: each is a mask
over the rows of one table.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.guards import ratio
from tickerloom.learning.boosting import Forest, Growth, Softmax, fit_forest
from tickerloom.operators.features import FEATURES
from tickerloom.operators.labels import CLASSES, chrono_split
from tickerloom.operators.selection import usable_rows_gate
from tickerloom.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROBABILITIES = [f"prob_{c.lower()}" for c in CLASSES]


@dataclass(frozen=True)
class ClassifierSettings:
    """``block_days``: test rows are scored in calendar blocks of so many days, each by a model fitted on older rows."""

    rounds: int = 200
    step: float = 0.05
    depth: int = 4
    min_leaf: int = 10
    bins: int = 64
    block_days: int = 180

    def growth(self) -> Growth:
        return Growth(self.rounds, self.step, self.depth, self.min_leaf, self.bins)


@dataclass
class BlockModels:
    """Models of calendar blocks: set ``k`` of the forest scores the block that starts on ``starts[k]``."""

    starts: list[date]
    forest: Forest


def with_block(rows: DataFrame, block_days: int) -> DataFrame:
    """Add ``block``, the first day of the calendar block ``next_date`` lies in. Blocks are counted from 1970, so they do
    not depend on which series a panel holds."""
    start = F.floor(F.unix_date("next_date") / block_days) * block_days
    return rows.withColumn("block", F.date_from_unix_date(start.cast("int")))


def block_starts(rows: DataFrame, block_days: int) -> list[date]:
    """First days of the blocks with rows, in order; as many as the calendar span has blocks."""
    found = with_block(rows, block_days).select("block").distinct().collect()
    return sorted(r["block"] for r in found if r["block"] is not None)


def training_rows(rows: DataFrame, before: date) -> DataFrame:
    """All labelled rows of the panel that are known before a day: the one rule by which every fit picks its rows."""
    return rows.filter(older_than(before) & F.col("label").isNotNull())


def older_than(before: date) -> Column:
    return F.col("next_date") < F.lit(before)


def weighted_sets(rows: DataFrame, masks: list[Column]) -> DataFrame:
    """Labelled rows with ``w``, their weight in each set: balanced over the classes of the symbol's own rows in that set, 0
    where the mask is not true. The windows share one partitioning by symbol."""
    known = rows.filter(F.col("label").isNotNull())
    known = known.withColumns({f"_in{k}": F.coalesce(mask, F.lit(False)) for k, mask in enumerate(masks)})
    of_symbol, of_class = Window.partitionBy("symbol"), Window.partitionBy("symbol", "label")
    weights = []
    for k in range(len(masks)):
        own = F.col(f"_in{k}")
        classes = F.size(F.collect_set(F.when(own, F.col("label"))).over(of_symbol))
        weight = F.count_if(own).over(of_symbol) / (classes * F.count_if(own).over(of_class))
        weights.append(F.when(own, weight).otherwise(0.0))
    number = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")) - 1
    return known.withColumn("w", F.array(*weights).cast("array<double>")).select(
        *FEATURES, number.cast("double").alias("y"), F.xxhash64("symbol", "date").alias("draw"), "w"
    )


def fit_sets(rows: DataFrame, masks: list[Column], settings: ClassifierSettings) -> Forest:
    """One model per mask, all in the same passes over the rows that any of them holds."""
    loss = Softmax(len(CLASSES))
    if not masks:
        return fit_forest(rows, 0, loss, settings.growth())
    held = F.exists("w", lambda w: w > 0)
    return fit_forest(stage(weighted_sets(rows, masks).filter(held), "training"), len(masks), loss, settings.growth())


def train_classifier(train: DataFrame, settings: ClassifierSettings = ClassifierSettings()) -> Forest:
    """A single model of all labelled rows, with balanced weights; a class without a row gets probability 0."""
    return fit_sets(train, [F.lit(True)], settings)


def decide(up: Column, down: Column, neutral: Column) -> Column:
    """Class with the largest probability; equal ones go by name, DOWN before NEUTRAL before UP."""
    return (
        F.when((down >= neutral) & (down >= up), F.lit("DOWN"))
        .when(neutral >= up, F.lit("NEUTRAL"))
        .otherwise(F.lit("UP"))
    )


def with_probabilities(rows: DataFrame, forest: Forest, number: Column | None = None) -> DataFrame:
    """Add ``prob_up, prob_down, prob_neutral`` (summing to one, 0 for a class never seen) and ``signal``, by set ``number`` of
    the forest (default: the first). All are null where the set is null or had no rows. Columns stay in place: only the
    inputs cross to Python, a batch at a time."""
    loss = Softmax(len(CLASSES))

    @F.pandas_udf("array<double>")
    def shares(own: pd.Series, *inputs: pd.Series) -> pd.Series:
        x = np.column_stack([i.astype(float) for i in inputs])
        out = pd.Series([None] * len(own), dtype=object)
        for k in own.dropna().unique().astype(int):
            if forest.fitted[k]:
                at = np.flatnonzero(own == k)
                for begin in range(0, len(at), 2048):
                    some = at[begin : begin + 2048]
                    out.iloc[some] = list(loss.shares(forest.scores(x[some], k).T).T)
        return out

    own = F.lit(0) if number is None else number
    scored = rows.withColumn("_shares", shares(own.cast("int"), *FEATURES))
    raw = [F.col("_shares")[k] for k in range(len(CLASSES))]
    total = raw[0] + raw[1] + raw[2]
    scored = scored.withColumns({p: ratio(share, total) for p, share in zip(PROBABILITIES, raw)})
    signal = F.when(F.col("_shares").isNotNull(), decide(*[F.col(p) for p in PROBABILITIES]))
    return scored.withColumns(
        {p: F.when(F.col("_shares").isNotNull(), F.col(p)) for p in PROBABILITIES} | {"signal": signal}
    ).drop("_shares")


def predict_signals(test: DataFrame, forest: Forest) -> DataFrame:
    """Signals dated on the day they are about. ``(symbol, date)`` is unique because the input rows are."""
    return with_probabilities(test, forest).select(
        "symbol", F.col("next_date").alias("date"), "signal", *PROBABILITIES
    )


def block_masks(starts: list[date]) -> list[Column]:
    """Training rows of each block: all rows of the panel older than its first day."""
    return [older_than(start) for start in starts]


def block_models(
    rows: DataFrame,
    settings: ClassifierSettings,
    fit: Callable[[DataFrame, list[Column], ClassifierSettings], Forest] = fit_sets,
) -> BlockModels:
    """Models of every calendar block of test rows of a split panel, fitted on all rows of the panel older than the block's
    first day; a block without older rows stays unfitted. ``fit`` may return a stored forest."""
    starts = block_starts(rows.filter("part = 'test'"), settings.block_days)
    return BlockModels(starts, fit(rows, block_masks(starts), settings))


def set_of_block(starts: list[date]) -> Column:
    """Number of the row's block among ``starts``, null if it is not there."""
    place = F.array_position(F.array(*[F.lit(s) for s in starts]).cast("array<date>"), F.col("block"))
    return F.when(place > 0, place - 1)


def with_block_probabilities(test: DataFrame, models: BlockModels, settings: ClassifierSettings) -> DataFrame:
    """Probabilities and signals of test rows, each by its own block's model."""
    blocked = with_block(test, settings.block_days)
    return with_probabilities(blocked, models.forest, set_of_block(models.starts)).drop("block")


def score_blocks(rows: DataFrame, settings: ClassifierSettings) -> DataFrame:
    """Probabilities and signals of the test rows of a split panel, a stored table.

    Test rows are cut into calendar blocks; each is scored by a model fitted on all rows of the panel older than the
    block's first day. No series decides what the others are trained on, and nothing newer than a scored row is
    learned from. Rows of a block without older rows get null probabilities and signals.
    """
    return with_block_probabilities(rows.filter("part = 'test'"), block_models(rows, settings), settings)


def generate_signals(
    panel: DataFrame, settings: ClassifierSettings = ClassifierSettings(), models: Forest | BlockModels | None = None
) -> DataFrame:
    """Signals for the last 20 % of every usable series of a labelled panel, from the given models or from one per
    calendar block. A panel with ``include_next`` also gets tomorrow's signal. The panel is read several times, so it should
    be a stored table."""
    split = split_usable(panel)
    test = split.filter("part = 'test'")
    if isinstance(models, Forest):
        return predict_signals(test, models)
    scored = with_block_probabilities(test, models, settings) if models else score_blocks(split, settings)
    return scored.select("symbol", F.col("next_date").alias("date"), "signal", *PROBABILITIES)


def split_usable(panel: DataFrame) -> DataFrame:
    return chrono_split(usable_rows_gate(panel))
