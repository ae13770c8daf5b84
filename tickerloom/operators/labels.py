"""Direction labels from each series' own return distribution, and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.operators.features import HISTORY, feature_rows
from tickerloom.operators.selection import MIN_ROWS, MIN_VARIATION, with_series_quality

UP, DOWN, NEUTRAL = "UP", "DOWN", "NEUTRAL"
CLASSES = [UP, DOWN, NEUTRAL]
LOW_Q, HIGH_Q = 0.3, 0.7
FALLBACK = 0.01  # thresholds of a series that never moves
TRAIN_SHARE = 0.8
N_FOLDS = 3

def whole_series() -> WindowSpec:
    return Window.partitionBy("symbol")


def threshold_columns(value: str = "r") -> dict[str, Column]:
    """Exact interpolated percentiles of the non-zero returns; usable in ``agg`` and over a window."""
    moved = F.when(F.col(value) != 0, F.col(value))
    return {"p30": F.percentile(moved, F.lit(LOW_Q)), "p70": F.percentile(moved, F.lit(HIGH_Q))}


def exact_percentiles(df: DataFrame) -> DataFrame:
    found = df.groupBy("symbol").agg(*[c.alias(n) for n, c in threshold_columns().items()])
    return found.fillna({"p30": -FALLBACK, "p70": FALLBACK})


def with_thresholds(df: DataFrame, fit_on: str = "all") -> DataFrame:
    """Attach each symbol's thresholds to its rows without another shuffle.

    ``fit_on="train"`` looks only at returns known inside the first 80 % of the feature rows, which removes the
    mild look-ahead of taking the percentiles over the full series.
    """
    value = "r"
    if fit_on == "train":
        n_rows = F.count(F.lit(1)).over(whole_series())
        last_train = F.floor((n_rows - HISTORY - 1) * F.lit(TRAIN_SHARE)) + HISTORY
        df = df.withColumn("_last", last_train).withColumn(
            "_r", F.when(F.col("i") <= F.col("_last"), F.col("r"))
        )
        value = "_r"
    over = {n: c.over(whole_series()) for n, c in threshold_columns(value).items()}
    return df.withColumns(over).fillna({"p30": -FALLBACK, "p70": FALLBACK}).drop("_last", "_r")


def direction(value: Column) -> Column:
    return (
        F.when(value > F.col("p70"), F.lit(UP)).when(value < F.col("p30"), F.lit(DOWN)).otherwise(F.lit(NEUTRAL))
    )


def with_label_inputs(frame: DataFrame, fit_on: str = "all") -> DataFrame:
    """Add label, thresholds, series quality, position ``k`` and number ``n`` of feature rows and the number of
    different labels. All of it reuses the frame's partitioning by symbol, so a stored frame that carries these
    columns needs no further shuffle to become a training panel."""
    measured = with_series_quality(with_thresholds(frame, fit_on))
    label = F.when(F.col("next_return").isNotNull(), direction(F.col("next_return")))
    own = F.when(F.col("i") >= HISTORY, F.col("label"))
    return (
        measured.withColumn("label", label)
        .withColumn("n_labels", F.size(F.collect_set(own).over(whole_series())))
        .withColumns(
            {
                "k": (F.col("i") - HISTORY).cast("bigint"),
                "n": (F.col("n_rows") - HISTORY - 1).cast("bigint"),
            }
        )
    )


def labelled_panel(
    frame: DataFrame,
    min_rows: int = MIN_ROWS,
    min_variation: float = MIN_VARIATION,
    fit_on: str = "all",
    include_next: bool = False,
) -> DataFrame:
    """Labelled feature rows of the series that are good enough.

    ``include_next`` keeps the newest row, whose next day is still unknown: its label is null, it is dated one day
    ahead and it counts as a row to predict.
    """
    measured = frame if "n_labels" in frame.columns else with_label_inputs(frame, fit_on)
    good = measured.filter((F.col("n_rows") >= min_rows) & (F.col("cv") >= min_variation))
    if include_next:
        return good.filter(F.col("i") >= HISTORY).withColumn(
            "next_date", F.coalesce("next_date", F.date_add("date", 1))
        )
    return feature_rows(good)


def label_distribution(labelled: DataFrame, *more: Column) -> DataFrame:
    """Rows per class and symbol, with any further aggregates the caller wants from the same pass."""
    counts = [F.count_if(F.col("label") == c).alias(f"n_{c.lower()}") for c in CLASSES]
    return labelled.groupBy("symbol").agg(*counts, *more)


def chrono_split(labelled: DataFrame) -> DataFrame:
    """Mark the first 80 % of every series as training rows."""
    cut = F.floor(F.col("n") * F.lit(TRAIN_SHARE))
    return labelled.withColumn("part", F.when(F.col("k") < cut, F.lit("train")).otherwise(F.lit("test")))


def walk_forward_folds(labelled: DataFrame, folds: int = N_FOLDS) -> DataFrame:
    """Expanding folds: fold ``f`` tests one of the last ``folds`` equal slices and trains on all rows before it.

    Each row is repeated at most ``folds`` times, a constant.
    """
    size = F.expr(f"n div {folds + 1}")
    start = F.col("n") - (F.lit(folds) - F.col("fold")) * size
    return (
        labelled.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(folds)])))
        .filter(F.col("k") < start + size)
        .withColumn("part", F.when(F.col("k") < start, F.lit("train")).otherwise(F.lit("test")))
    )


def usable_folds(folded: DataFrame) -> DataFrame:
    """``(symbol, fold)`` pairs whose training and test parts both hold at least two classes."""

    def classes_in(part: str) -> Column:
        return sum(
            (F.max(((F.col("part") == part) & (F.col("label") == c)).cast("int")) for c in CLASSES), F.lit(0)
        )

    return (
        folded.groupBy("symbol", "fold")
        .agg(classes_in("train").alias("k_train"), classes_in("test").alias("k_test"))
        .filter((F.col("k_train") >= 2) & (F.col("k_test") >= 2))
        .select("symbol", "fold")
    )


def balanced_weights(train: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Weight ``n / (classes * n_class)`` per class; training rows only."""
    counts = train.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_class"))
    over_keys = Window.partitionBy(*keys)  # at most three rows per key
    n, k = F.sum("n_class").over(over_keys), F.count(F.lit(1)).over(over_keys)
    return counts.withColumn("weight", n / (k * F.col("n_class")))


def with_balanced_weights(train: DataFrame) -> DataFrame:
    """The same weights attached to the rows; the windows reuse the partitioning by symbol."""
    n_class = F.count(F.lit(1)).over(Window.partitionBy("symbol", "label"))
    k = F.size(F.collect_set("label").over(whole_series()))
    return train.withColumn("weight", F.count(F.lit(1)).over(whole_series()) / (k * n_class))


def persistence_prediction(labelled: DataFrame) -> DataFrame:
    """A deterministic predictor for checking the metrics: tomorrow repeats today's direction.

    Scores are the distances of today's return from the thresholds, so they order rows without being probabilities.
    """
    r, low, high = F.col("r"), F.col("p30"), F.col("p70")
    zero = F.lit(0.0)
    return labelled.withColumns(
        {
            "prediction": direction(r),
            "score_up": F.greatest(r - high, zero),
            "score_down": F.greatest(low - r, zero),
            "score_neutral": F.least(F.greatest(high - r, zero), F.greatest(r - low, zero)),
        }
    )
