"""Walk-forward evaluation of the classifier."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.learning.classifier import (
    ClassifierSettings,
    block_starts,
    fit_sets,
    older_than,
    with_block,
    with_probabilities,
)
from tickerloom.operators.evaluation import fold_metrics, symbol_metrics
from tickerloom.operators.labels import N_FOLDS, usable_folds, walk_forward_folds
from tickerloom.operators.selection import usable_rows_gate
from tickerloom.workspace import stage


def fold_end(fold: int, folds: int = N_FOLDS) -> Column:
    """Position at which the test slice of a fold ends, as ``walk_forward_folds`` cuts it."""
    size = F.expr(f"n div {folds + 1}")
    return F.col("n") - (folds - 1 - fold) * size


def fold_sets(folded: DataFrame, settings: ClassifierSettings) -> list[tuple[int, date]]:
    """``(fold, first day)`` of every calendar block in which a fold has test rows."""
    tests = folded.filter("part = 'test'")
    return [(f, start) for f in range(N_FOLDS) for start in block_starts(tests.filter(F.col("fold") == f), settings.block_days)]


def walk_forward_eval(panel: DataFrame, settings: ClassifierSettings = ClassifierSettings()) -> DataFrame:
    """Metrics per symbol, averaged over expanding folds; each fold's test rows are scored by models of older rows only.

    A fold's test rows are cut into calendar blocks. Every (fold, block) is a mask over the panel, rows of the fold that are
    older than the block, and all of them are fitted in the same passes. Test rows without any older row cannot be scored;
    ``n_unscored`` counts them, and symbols of which no row can be scored have no other metric. The panel should be a stored
    table.
    """
    usable = usable_rows_gate(panel)
    folded = walk_forward_folds(usable)
    sets = fold_sets(folded, settings)
    forest = fit_sets(usable, [(F.col("k") < fold_end(f)) & older_than(start) for f, start in sets], settings)
    tests = with_block(folded.filter("part = 'test'"), settings.block_days)
    own = F.lit(None).cast("int")
    for k, (f, start) in enumerate(sets):
        own = F.when((F.col("fold") == f) & (F.col("block") == F.lit(start)), F.lit(k)).otherwise(own)
    renamed = with_probabilities(tests, forest, own).withColumnsRenamed(
        {"signal": "prediction", "prob_up": "score_up", "prob_down": "score_down", "prob_neutral": "score_neutral"}
    )
    kept = ["symbol", "fold", "part", "label", "prediction", "score_up", "score_down", "score_neutral"]
    judged = stage(renamed.select(*kept), "judged")
    unscored = judged.groupBy("symbol").agg(F.count_if(F.col("prediction").isNull()).alias("n_unscored"))
    metrics = fold_metrics(judged.filter("prediction is not null"), usable_folds(folded))
    found = symbol_metrics(metrics, usable)
    names = [c for c in found.columns if c != "symbol"]
    return unscored.join(found, "symbol", "left").filter("status is not null or n_unscored > 0").select("symbol", *names, "n_unscored")
