"""Top-n reports and summaries. Limits here are the report's size; ties are broken by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.selection import at_latest_date, coverage, semi_join_coverage
from tickerloom.ordering import running_total

# Rank error of the quantile sketch is one in this many rows. The sketches of all tasks meet in one merge, so this
# also bounds what that merge receives.
QUANTILE_ACCURACY = 10_000


def top_by(df: DataFrame, column: str, n: int) -> DataFrame:
    """``n`` largest rows; runs as a per-partition top-n followed by a merge, not as a full sort."""
    return df.orderBy(F.desc_nulls_last(column), F.asc("symbol")).limit(n)


def top_safest(scored: DataFrame, n: int = 10) -> DataFrame:
    shown = ["symbol", "close_usd", "volatility_30d", "return_30d", "safety_score"]
    return top_by(at_latest_date(scored).select(*shown), "safety_score", n)


def top_by_volume(scored: DataFrame, n: int = 30, min_coverage: float = 0.9) -> DataFrame:
    """Most traded symbols of the latest day among those with enough history."""
    eligible = semi_join_coverage(at_latest_date(scored), coverage(scored, min_coverage))
    return top_by(eligible, "avg_volume_30d", n)


def leaderboard(scored: DataFrame, sort_by: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of the latest day, sorted by a column of the user's choice."""
    if n < 1:
        raise ValueError(f"n must be positive, not {n}")
    return top_by(at_latest_date(scored), sort_by, n)


def risk_scatter(scored: DataFrame) -> DataFrame:
    return at_latest_date(scored).select("symbol", "volatility_30d", "safety_score")


def compare_series(scored: DataFrame, first: str, second: str) -> DataFrame:
    chosen = scored.filter(F.col("symbol").isin(first, second))
    return chosen.select("symbol", "date", "close_usd", "volatility_30d").orderBy("symbol", "date")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def _summary(values: DataFrame) -> DataFrame:
    return values.groupBy("measure").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


DESCRIBED = ["measure", "n", "mean", "stddev", "min", "q25", "q50", "q75", "max"]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column.

    A quartile is the smallest value that at least that share of the known values do not exceed. Values are counted,
    and the counts summed over ranges of the sorted values, so no task holds a whole column. Columns without values have
    null statistics. The table is read twice.
    """
    values = _long(df, columns)
    summary = _summary(values)
    counts = values.filter("value is not null").groupBy("measure", "value").agg(F.count(F.lit(1)).alias("times"))
    reached = running_total(counts, ["measure", "value"], "times", "reached")
    before = Window.orderBy("measure").rowsBetween(Window.unboundedPreceding, -1)  # one row per column
    sizes = summary.select("measure", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    placed = reached.join(F.broadcast(sizes), "measure").withColumn("reached", F.col("reached") - F.col("earlier"))
    quartiles = placed.groupBy("measure").agg(
        *[
            F.min(F.when(F.col("reached") >= F.ceil(F.col("n") * share), F.col("value"))).alias(name)
            for share, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ]
    )
    return summary.join(quartiles, "measure", "left").select(*DESCRIBED)


def describe_approx(df: DataFrame, columns: list[str]) -> DataFrame:
    """As :func:`describe` with quartiles from mergeable sketches, each off by at most one in ``QUANTILE_ACCURACY`` ranks; a
    single pass over the table."""
    values = _long(df, columns)
    sketches = values.groupBy("measure").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], QUANTILE_ACCURACY).alias("q"))
    named = sketches.select("measure", *[F.get("q", F.lit(k)).alias(f"q{p}") for k, p in enumerate((25, 50, 75))])
    return _summary(values).join(named, "measure").select(*DESCRIBED)
