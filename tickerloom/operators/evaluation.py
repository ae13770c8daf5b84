"""Classifier metrics per group, computed as aggregations over labelled predictions.

Inputs carry ``label``, ``prediction`` and, for the ranking metric, ``score_up``, ``score_down``, ``score_neutral``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.guards import ratio
from tickerloom.operators.labels import CLASSES, NEUTRAL, label_distribution, usable_folds
from tickerloom.operators.ranking import QUANTILE_ACCURACY
from tickerloom.workspace import stage

ACCURACY_WITHOUT_CALLS = 0.5


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per label and prediction; at most nine per key."""
    return df.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Support, predictions and hits per class, from confusion counts."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), none.alias("called"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), none.alias("support"), F.col("n").alias("called"), none.alias("hits")),
    )
    return (
        counts.select(*keys, F.inline(sides))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])
    )


def f1_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Support-weighted and plain mean of the per-class F1, over all classes seen as truth or as prediction."""
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("called"))
    scored = class_counts(confusion(df, keys), keys).withColumn("f1", f1)
    return scored.groupBy(*keys).agg(
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
    )


def directional_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of right calls among rows where truth and prediction both take a side; 0.5 if there are none."""
    sided = F.when((F.col("label") != NEUTRAL) & (F.col("prediction") != NEUTRAL), F.col("n"))
    right = F.when(F.col("label") == F.col("prediction"), sided)
    share = ratio(F.coalesce(F.sum(right), F.lit(0)), F.sum(sided), ACCURACY_WITHOUT_CALLS)
    return confusion(df, keys).groupBy(*keys).agg(share.alias("dir_accuracy"))


def auc_ovr_weighted(df: DataFrame, keys: list[str]) -> DataFrame:
    """One-vs-rest area under the curve, weighted by support; 0 when some class is absent or is the only one.

    Rows are first reduced to counts per distinct score. A running sum over the scores then gives, for every
    positive, the number of negatives ranked below it, ties counting one half.
    """
    per_class = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                (F.col("label") == c).cast("bigint").alias("pos"),
                F.col(f"score_{c.lower()}").alias("score"),
            )
            for c in CLASSES
        ]
    )
    ties = (
        df.select(*keys, F.inline(per_class))
        .groupBy(*keys, "class", "score")
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    )
    below = Window.partitionBy(*keys, "class").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2))
    areas = ranked.groupBy(*keys, "class").agg(
        F.sum("pos").alias("n_pos"), F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("area")
    )
    whole = F.count("area") == len(CLASSES)
    weighted = F.sum(F.col("area") * F.col("n_pos")) / F.sum("n_pos")
    return areas.groupBy(*keys).agg(F.when(whole, weighted).otherwise(F.lit(0.0)).alias("auc_roc"))


def with_tied_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of each class's score among the rows of a key, ties sharing their mean rank, as ``rank_<class>``. Rank and number of
    ties come from one sort per class."""
    for c in CLASSES:
        score = f"score_{c.lower()}"
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(score))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, score))
        df = df.withColumn(f"rank_{c.lower()}", rank + (ties - 1) / 2)
    return df


def all_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """``f1_weighted, f1_macro, dir_accuracy, auc_roc`` per key from one exchange and one aggregate, equal to what
    :func:`f1_scores`, :func:`directional_accuracy` and :func:`auc_ovr_weighted` give one by one.

    The rows of a key meet in one task, as many as a series has days. An area under the curve is the sum of the ranks of the
    class's rows above the least it could be.
    """
    label, call = F.col("label"), F.col("prediction")
    sums = []
    for c in CLASSES:
        name = c.lower()
        sums += [
            F.count_if(label == c).alias(f"support_{name}"),
            F.count_if(call == c).alias(f"called_{name}"),
            F.count_if((label == c) & (call == c)).alias(f"hits_{name}"),
            F.sum(F.when(label == c, F.col(f"rank_{name}"))).alias(f"ranks_{name}"),
        ]
    sided = (label != NEUTRAL) & (call != NEUTRAL)
    sums += [F.count_if(sided).alias("sided"), F.count_if(sided & (label == call)).alias("right"), F.count("label").alias("n")]
    found = with_tied_ranks(df, keys).groupBy(*keys).agg(*sums)
    f1, weighted, areas, seen = [], [], [], []
    for c in CLASSES:
        support, called, hits, ranks = (F.col(f"{x}_{c.lower()}") for x in ("support", "called", "hits", "ranks"))
        score = ratio(2 * hits, support + called)
        f1.append(F.when(support + called > 0, score))
        seen.append((support + called > 0).cast("int"))
        weighted.append(F.when(support > 0, score * support).otherwise(0.0))
        areas.append(F.try_divide(ranks - support * (support + 1) / 2, support * (F.col("n") - support)) * support)
    plain = sum((F.coalesce(x, F.lit(0.0)) for x in f1[1:]), F.coalesce(f1[0], F.lit(0.0)))
    return found.select(
        *keys,
        ratio(sum(weighted[1:], weighted[0]), F.col("n")).alias("f1_weighted"),
        F.try_divide(plain, sum(seen[1:], seen[0])).alias("f1_macro"),
        ratio(F.col("right"), F.col("sided"), ACCURACY_WITHOUT_CALLS).alias("dir_accuracy"),
        F.coalesce((areas[0] + areas[1] + areas[2]) / F.col("n"), F.lit(0.0)).alias("auc_roc"),
    )


def fold_metrics(folded: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """All metrics per symbol and fold, test rows of usable folds only.

    ``usable`` names the usable folds where ``folded`` has no training rows to tell them by; otherwise the rows are stored
    once and read for both.
    """
    keys = ["symbol", "fold"]
    rows = folded.select(*keys, "part", "label", "prediction", "score_up", "score_down", "score_neutral")
    if usable is None:
        rows = stage(rows, "folded")
        usable = usable_folds(rows)
    return all_metrics(rows.filter("part = 'test'"), keys).join(usable, keys, "left_semi")


def fold_mean(metrics: DataFrame) -> DataFrame:
    names = ["f1_weighted", "f1_macro", "dir_accuracy", "auc_roc"]
    return metrics.groupBy("symbol").agg(*[F.avg(n).alias(n) for n in names])


def symbol_metrics(metrics: DataFrame, labelled: DataFrame) -> DataFrame:
    """The evaluation table: mean fold metrics, class counts and series length per symbol.

    ``rmse`` and ``mae`` are kept in the schema and always 0.
    """
    described = label_distribution(labelled, F.max("n_rows").cast("bigint").alias("n_days"))
    return (
        fold_mean(metrics)
        .join(described, "symbol")
        .select(
            "symbol", "f1_weighted", "f1_macro", "dir_accuracy", "auc_roc",
            F.lit(0.0).alias("rmse"), F.lit(0.0).alias("mae"),
            "n_up", "n_down", "n_neutral", "n_days", F.lit("OK").alias("status"),
        )
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Averages and sketch-based medians over all symbols."""

    def median(c: str) -> Column:
        return F.percentile_approx(c, 0.5, QUANTILE_ACCURACY)

    return metrics.agg(
        F.avg("f1_weighted").alias("avg_f1_w"),
        median("f1_weighted").alias("med_f1_w"),
        F.avg("f1_macro").alias("avg_f1_m"),
        F.avg("dir_accuracy").alias("avg_dir"),
        median("dir_accuracy").alias("med_dir"),
        F.avg("auc_roc").alias("avg_auc"),
        F.avg("rmse").alias("avg_rmse"),
        F.avg("mae").alias("avg_mae"),
    )


# The cuts reported for each metric.
CUTS = {
    "f1_good": ("f1_weighted", 0.5),
    "dir_50": ("dir_accuracy", 0.50),
    "dir_52": ("dir_accuracy", 0.52),
    "dir_55": ("dir_accuracy", 0.55),
    "auc_good": ("auc_roc", 0.55),
}


def threshold_counts(metrics: DataFrame) -> DataFrame:
    """How many symbols reach each cut, all in one pass."""
    return metrics.agg(*[F.count_if(F.col(c) >= cut).alias(name) for name, (c, cut) in CUTS.items()])


def filtered_out_count(all_rows: DataFrame, metrics: DataFrame) -> DataFrame:
    total = all_rows.agg(F.count_distinct("symbol")).scalar()
    return metrics.agg(F.count(F.lit(1)).alias("n_eval")).select(
        total.alias("n_total"), "n_eval", (total - F.col("n_eval")).alias("n_filtered")
    )
