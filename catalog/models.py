"""Signals and forecasts at the library's default settings, over every row of the panel. Values of fitted models have no SQL counterpart;
statements check what must hold exactly, such as the rows each model learns from."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.learning import forecast as C
from tickerloom.learning import quantile as Q
from tickerloom.learning.classifier import (
    ClassifierSettings,
    block_models,
    fit_sets,
    older_than,
    with_block_probabilities,
    with_probabilities,
)
from tickerloom.learning.store import reusing
from tickerloom.learning.walkforward import walk_forward_eval
from tickerloom.operators import labels as L
from tickerloom.operators import signals as G
from tickerloom.operators.selection import MIN_FEATURE_ROWS, MIN_LABELS
from tickerloom.workspace import fresh_path, stage

SETTINGS = ClassifierSettings()
SETTINGS_Q = Q.QuantileSettings()


def split_panel(spark, folder):
    return stage(L.chrono_split(frames.labelled(spark, folder)), "panel")


def registered_models(split):
    """Models of every block of a split panel. Queries that start from the same panel share one fit."""
    return block_models(split, SETTINGS, reusing(fit_sets, frames.registry(split.sparkSession), "panel"))


def block_signals(test, models):
    """Signals dated on the day they are about, each by its block's models."""
    return with_block_probabilities(test, models, SETTINGS).withColumn("date", F.col("next_date"))


@query("train_classifier", using("labelled", body=f"""
, blocks AS (
  SELECT DISTINCT CAST(DATE '1970-01-01' + CAST(floor((next_date - DATE '1970-01-01') / {SETTINGS.block_days}.0) * {SETTINGS.block_days} AS INT) AS DATE) AS block
  FROM labelled WHERE k >= floor(n * 0.8))
SELECT b.block, l.label, count(*) AS n, count(*) AS n_scored, true AS better_than_chance
FROM blocks b JOIN labelled l ON l.next_date < b.block GROUP BY b.block, l.label"""))
def fit_classifier(spark, folder):
    """Training rows of each block by label, how many of them its model scores, and whether it finds more of the label again
    than a draw among three classes."""
    split = split_panel(spark, folder)
    models = registered_models(split)
    known = [F.when(older_than(start), F.struct(F.lit(k).alias("set"), F.lit(start).alias("block"))) for k, start in enumerate(models.starts)]
    own = F.explode(F.filter(F.array(*known), lambda b: b.isNotNull())) if known else F.lit(None).cast("struct<set:int,block:date>")
    rows = split.withColumn("_own", own).filter("_own is not null")
    fitted = with_probabilities(rows, models.forest, F.col("_own.set")).withColumn("block", F.col("_own.block"))
    return fitted.groupBy("block", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("signal").alias("n_scored"),
        (F.count_if(F.col("signal") == F.col("label")) * 3 > F.count(F.lit(1))).alias("better_than_chance"),
    )


@query("predict_signals", using("labelled", body="""
SELECT symbol, next_date AS date, 1.0::DOUBLE AS total, true AS largest_is_signal FROM labelled WHERE k >= floor(n * 0.8)"""))
def predict(spark, folder):
    """Which days get a signal, what its probabilities add up to and whether the signal is the likeliest class."""
    split = split_panel(spark, folder)
    signals = block_signals(split.filter("part = 'test'"), registered_models(split))
    of_signal = F.element_at(
        F.create_map(F.lit("UP"), "prob_up", F.lit("DOWN"), "prob_down", F.lit("NEUTRAL"), "prob_neutral"), F.col("signal")
    )
    return signals.select(
        "symbol",
        "date",
        F.round(F.col("prob_up") + F.col("prob_down") + F.col("prob_neutral"), 6).alias("total"),
        (of_signal == F.greatest("prob_up", "prob_down", "prob_neutral")).alias("largest_is_signal"),
    )


@query("model_store", using("labelled", body="""
SELECT count(*) AS n, 0::BIGINT AS n_different, true AS reused FROM labelled WHERE k >= floor(n * 0.8)"""))
def model_store(spark, folder):
    """The second request must find the first one's models and give the same signals."""
    split = split_panel(spark, folder)
    found = []
    fit = reusing(fit_sets, fresh_path(spark, "store"), "panel", found)
    fresh, again = block_models(split, SETTINGS, fit), block_models(split, SETTINGS, fit)
    test = split.filter("part = 'test'")
    first = block_signals(test, fresh)
    second = block_signals(test, again).select("symbol", "date", F.col("prob_up").alias("prob_up_again"))
    both = first.select("symbol", "date", "prob_up").join(second, ["symbol", "date"])
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("prob_up").eqNullSafe(F.col("prob_up_again"))).alias("n_different"),
        F.lit(found == [False, True]).alias("reused"),
    )


@query("generate_signals")
def signals(spark, folder):
    return frames.generated(spark, folder)


@query("signal_views", using("labelled", body=f"""
, usable AS (
  SELECT symbol, next_date, k, n FROM labelled
  WHERE symbol IN (SELECT symbol FROM labelled GROUP BY symbol HAVING count(*) >= {MIN_FEATURE_ROWS} AND count(DISTINCT label) >= {MIN_LABELS})
), shown AS (SELECT * FROM usable WHERE k >= floor(n * 0.8))
SELECT symbol, max(next_date) AS date, count(*) AS n_history, max(next_date) = (SELECT max(next_date) FROM shown) AS is_latest,
       (SELECT count(*) FROM shown WHERE next_date = (SELECT max(next_date) FROM shown)) AS n_counted, true AS is_action, true AS is_likeliest
FROM shown GROUP BY symbol"""))
def signal_views(spark, folder):
    """The views over generated signals, a row per symbol: its newest signal in the roster, the length of its history, whether it is
    among the latest signals, how many of those are counted, and whether action and confidence are those of a likeliest class."""
    rows = frames.generated(spark, folder)
    latest = G.latest_signals(rows).select("symbol", F.lit(True).alias("_shown"))
    counts = G.signal_counts(rows).select((F.col("n_up") + F.col("n_down") + F.col("n_neutral")).alias("n_counted"))
    history = rows.groupBy("symbol").agg(F.count("signal").alias("n_history"))
    roster = G.signal_roster(rows).join(history, "symbol").join(latest, "symbol", "left").crossJoin(F.broadcast(counts))
    return roster.select(
        "symbol", "date", "n_history", F.coalesce("_shown", F.lit(False)).alias("is_latest"), "n_counted",
        F.col("signal").isin("BUY", "SELL", "HOLD").alias("is_action"),
        F.col("confidence").between(1 / 3 - 1e-9, 1.0).alias("is_likeliest"),
    )


def simple_signals(spark, folder):
    """Signals of the deterministic predictor, in the layout of generated ones."""
    scores = [F.col(f"score_{c}").alias(f"prob_{c}") for c in ("up", "down", "neutral")]
    rows = frames.predicted(spark, folder)
    return rows.select("symbol", F.col("next_date").alias("date"), F.col("prediction").alias("signal"), *scores)


SIMPLE = """
SELECT symbol, next_date AS date, prediction AS signal, round(score_up, 6) AS prob_up, round(score_down, 6) AS prob_down,
       round(score_neutral, 6) AS prob_neutral FROM labelled"""


@query("latest_signals", using("labelled", body=f"{SIMPLE} WHERE next_date = (SELECT max(next_date) FROM labelled) ORDER BY score_up DESC, symbol"))
def latest_signals(spark, folder):
    return rounded(G.latest_signals(simple_signals(spark, folder)))


@query("signal_history", using("labelled", body=f"{SIMPLE} WHERE symbol = 'BTCUSDT' ORDER BY next_date"))
def signal_history(spark, folder):
    return rounded(G.signal_history(simple_signals(spark, folder), "BTCUSDT"))


@query("signal_roster", using("labelled", body="""
SELECT symbol, next_date AS date, CASE prediction WHEN 'UP' THEN 'BUY' WHEN 'DOWN' THEN 'SELL' ELSE 'HOLD' END AS signal,
       round(greatest(score_up, score_down, score_neutral), 6) AS confidence
FROM labelled QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY next_date DESC) = 1"""))
def signal_roster(spark, folder):
    return rounded(G.signal_roster(simple_signals(spark, folder)))


@query("signal_counts", using("labelled", body="""
SELECT count(*) FILTER (WHERE prediction = 'UP') AS n_up, count(*) FILTER (WHERE prediction = 'DOWN') AS n_down,
       count(*) FILTER (WHERE prediction = 'NEUTRAL') AS n_neutral
FROM labelled WHERE next_date = (SELECT max(next_date) FROM labelled)"""))
def signal_counts(spark, folder):
    return G.signal_counts(simple_signals(spark, folder))


@query("walk_forward_eval")
def evaluate(spark, folder):
    return walk_forward_eval(stage(frames.labelled(spark, folder), "panel"), SETTINGS)


@query("quantile_boost", using("labelled", body="""
SELECT CAST(q.alpha AS DOUBLE) AS alpha, count(*) AS n, true AS below_constant, true AS covers
FROM labelled, (VALUES (0.1), (0.5), (0.9)) q(alpha) GROUP BY q.alpha"""))
def boost(spark, folder):
    """Of each boosted quantile: training rows, whether its loss is below that of the constant it starts from, and whether the
    share of rows at or below it is the quantile's to five points."""
    rows = stage(frames.labelled(spark, folder), "labelled")
    found = []
    for model in Q.boost_quantiles(rows, C.QUANTILES, settings=SETTINGS_Q):
        y, guess = F.col("next_return"), F.col("guess")
        share = F.avg((y <= guess).cast("double"))
        found.append(
            Q.predict_quantile(rows, model, "guess").agg(
                F.lit(model.alpha).alias("alpha"),
                F.count(F.lit(1)).alias("n"),
                (Q.pinball(y, guess, model.alpha) < Q.pinball(y, F.lit(model.base), model.alpha)).alias("below_constant"),
                (F.abs(share - model.alpha) <= 0.05).alias("covers"),
            )
        )
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("forecast_trend")
def forecast_trend(spark, folder):
    return frames.forecast(spark, folder)


@query("recursive_rollout", using("usd_bars", body="""
SELECT symbol, 365::BIGINT AS n_days, CAST(max(date) + 1 AS DATE) AS first_date, CAST(max(date) + 365 AS DATE) AS last_date,
       365::BIGINT AS n_ordered, true AS all_positive FROM usd_bars GROUP BY symbol HAVING count(*) >= 180"""))
def recursive_rollout(spark, folder):
    """Length and shape of every symbol's cone: days, days in order p10 <= p50 <= p90, and whether prices stay positive."""
    cone = frames.forecast(spark, folder)
    ordered = (F.col("predicted_p10") <= F.col("predicted_p50")) & (F.col("predicted_p50") <= F.col("predicted_p90"))
    return cone.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(ordered).alias("n_ordered"),
        (F.min("predicted_p10") > 0).alias("all_positive"),
    )


@query("forecast_cone", using("returns", "thresholds", body="""
, steps AS MATERIALIZED (
  SELECT x.symbol, x.date, x.i AS t, greatest(-0.2, least(0.2, t.p30)) AS q10, greatest(-0.2, least(0.2, x.r)) AS q50,
         greatest(-0.2, least(0.2, t.p70)) AS q90 FROM returns x JOIN thresholds t ON t.symbol = x.symbol
), moves AS MATERIALIZED (
  SELECT symbol, date, t, least(q50, q50 + (q10 - q50) * exp(-t / 180.0)) AS r10, q50 AS r50,
         greatest(q50, q50 + (q90 - q50) * exp(-t / 180.0)) AS r90 FROM steps
), chain(symbol, t, date, p10, p50, p90) AS (
  SELECT symbol, -1::BIGINT, NULL::DATE, 100.0::DOUBLE, 100.0::DOUBLE, 100.0::DOUBLE FROM thresholds
  UNION ALL
  SELECT m.symbol, m.t, m.date, greatest(c.p10 * (1 + m.r10), 1e-9), greatest(c.p50 * (1 + m.r50), 1e-9),
         greatest(c.p90 * (1 + m.r90), 1e-9)
  FROM chain c JOIN moves m ON m.symbol = c.symbol AND m.t = c.t + 1)
SELECT symbol, date, round(ln(p10), 6) AS ln_p10, round(ln(p50), 6) AS ln_p50, round(ln(p90), 6) AS ln_p90
FROM chain WHERE t >= 0""").replace("WITH ", "WITH RECURSIVE ", 1).replace(")\n\n, steps", ")\n, steps"))
def forecast_cone(spark, folder):
    rows = L.with_thresholds(frames.returns(spark, folder)).select(
        "symbol", "date", F.col("i").alias("t"), F.col("p30").alias("q10"), F.col("r").alias("q50"),
        F.col("p70").alias("q90"), F.lit(100.0).alias("start"),
    )
    return rounded(C.forecast_cone(rows).select("symbol", "date", "ln_p10", "ln_p50", "ln_p90"))
