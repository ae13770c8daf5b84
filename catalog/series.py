"""Window measures: returns, volatility, the sixteen features, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.operators import features as X
from tickerloom.operators import labels as L
from tickerloom.operators import ranking as K
from tickerloom.operators.bars import dedup_key


def scored_query(name: str, *columns: str):
    """Project the scored series; the SQL computes the same columns from the bars."""
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, using("scored", body=f"SELECT symbol, date, {shown} FROM scored"))
    def run(spark, folder):
        return rounded(frames.scored(spark, folder).select("symbol", "date", *columns))


scored_query("prev_close", "prev_close_usd")
scored_query("daily_return", "daily_return")
scored_query("rolling_volatility", "volatility_7d", "volatility_30d")
scored_query("return_30d", "close_usd_30d_ago", "return_30d")
scored_query("avg_volume_30d", "avg_volume_30d")
scored_query("safety_score", "safe_volatility", "safety_score")


@query("dedup_rank", using("labelled", body="""
SELECT symbol, next_date AS date, round(min(score_up), 6) AS prob_up FROM (
  SELECT symbol, next_date, score_up FROM labelled UNION ALL SELECT symbol, next_date, score_up + 1 FROM labelled)
GROUP BY symbol, next_date"""))
def dedup_rank(spark, folder):
    once = frames.predicted(spark, folder).select("symbol", F.col("next_date").alias("date"), F.col("score_up").alias("prob_up"))
    twice = once.unionByName(once.withColumn("prob_up", F.col("prob_up") + 1))
    return rounded(dedup_key(twice, [F.col("prob_up").alias("_p")]))


def feature_query(name: str, columns: dict[str, str], *tables: str):
    """Compare feature columns with SQL expressions over ``returns`` windows."""
    shown = ", ".join(f"round({sql}, 6) AS {c}" for c, sql in columns.items())
    frame_names = {"w": "", **{f"w{n}": f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" for n in (7, 14, 20)}}
    windows = ", ".join(f"{w} AS (PARTITION BY symbol ORDER BY date{rows})" for w, rows in frame_names.items())

    @query(name, using("returns", body=f"SELECT symbol, date, {shown} FROM returns WINDOW {windows}"))
    def run(spark, folder):
        return rounded(frames.features(spark, folder).select("symbol", "date", *columns))


LAG_SQL = {n: (f"lag(r, {k}) OVER w" if k else "r") for n, k in
           {"lag1": 0, "lag2": 1, "lag3": 2, "lag5": 4, "lag7": 6, "lag14": 13}.items()}
MEAN_SQL = {"mean7": "avg(r) OVER w7", "mean14": "avg(r) OVER w14"}
STD_SQL = {"vol7": "stddev_pop(r) OVER w7 + 1e-9", "vol14": "stddev_pop(r) OVER w14 + 1e-9"}
RSI_SQL = {
    "rsi": "100 - 100 / (1 + coalesce(avg(r) FILTER (WHERE r > 0) OVER w14, 0.0)"
    " / coalesce(avg(-r) FILTER (WHERE r < 0) OVER w14, 1e-9))"
}
MOM_SQL = {"price_mom": "(p - lag(p, 30) OVER w) / (lag(p, 30) OVER w + 1e-9)"}
VOLUME_SQL = {"vol_ratio": "v / (avg(v) OVER w7 + 1e-9)"}
BAND_SQL = {"bb_pos": "(p - avg(p) OVER w20) / (2 * (stddev_pop(p) OVER w20 + 1e-9))"}
MARKET_SQL = {"btc_lag1": "lag(btc_return) OVER w"}

feature_query("feat_return", {"r": "r"})
feature_query("feat_lags", LAG_SQL)
feature_query("feat_rolling_mean", MEAN_SQL)
feature_query("feat_rolling_std", STD_SQL)
feature_query("feat_rsi14", RSI_SQL)
feature_query("feat_momentum30", MOM_SQL)
feature_query("feat_volume_ratio", VOLUME_SQL)
feature_query("feat_market_lag", MARKET_SQL)
feature_query("feat_bollinger_pos", BAND_SQL)


@query("feat_ema_macd", using("ema", body="""
SELECT symbol, CAST(i AS BIGINT) AS i, round(ema12, 6) AS ema12, round(ema26, 6) AS ema26,
       round(ema12 - ema26, 6) AS macd FROM ema"""))
def feat_ema_macd(spark, folder):
    emas = X.with_emas(frames.returns(spark, folder))
    return rounded(
        emas.select("symbol", F.col("i").cast("bigint").alias("i"), "ema12", "ema26",
                    (F.col("ema12") - F.col("ema26")).alias("macd"))
    )


ALL_SQL = {**LAG_SQL, **MEAN_SQL, **STD_SQL, **RSI_SQL, **MOM_SQL, **VOLUME_SQL, **BAND_SQL, **MARKET_SQL}


@query("feature_matrix", using("ema", body=f"""
SELECT f.symbol, f.date, {', '.join(c for c in ALL_SQL)}, round(e.ema12 - e.ema26, 6) AS macd FROM (
  SELECT symbol, date, i, lead(r) OVER w AS next_return, {', '.join(f'round({s}, 6) AS {c}' for c, s in ALL_SQL.items())}
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date),
    w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w14 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
    w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) f
JOIN ema e ON e.symbol = f.symbol AND e.i = f.i
WHERE f.i >= 30 AND f.next_return IS NOT NULL"""))
def feature_matrix(spark, folder):
    rows = X.feature_rows(frames.features(spark, folder))
    return rounded(rows.select("symbol", "date", *X.FEATURES))


@query("target_and_date", using("returns", body="""
SELECT symbol, date, round(lead(r) OVER w, 6) AS next_return, lead(date) OVER w AS next_date
FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date)"""))
def target_and_date(spark, folder):
    return rounded(frames.features(spark, folder).select("symbol", "date", "next_return", "next_date"))


@query("exact_percentiles", using("thresholds", body="SELECT symbol, round(p30, 6) AS p30, round(p70, 6) AS p70 FROM thresholds"))
def exact_percentiles(spark, folder):
    return rounded(L.exact_percentiles(frames.returns(spark, folder)))


@query("cdf_labels", using("labelled", body="SELECT symbol, next_date AS date, label FROM labelled"))
def cdf_labels(spark, folder):
    return frames.labelled(spark, folder).select("symbol", F.col("next_date").alias("date"), "label")


@query("chrono_split", using("labelled", body="""
SELECT symbol, next_date AS date, CASE WHEN k < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM labelled"""))
def chrono_split(spark, folder):
    return L.chrono_split(frames.labelled(spark, folder)).select("symbol", F.col("next_date").alias("date"), "part")


@query("walk_forward_folds", using("folded", body="SELECT symbol, next_date AS date, CAST(fold AS INT) AS fold, part FROM folded"))
def walk_forward_folds(spark, folder):
    return frames.folded(spark, folder).select("symbol", F.col("next_date").alias("date"), "fold", "part")


@query("balanced_weights", using("labelled", body="""
SELECT symbol, label, n_class, round(sum(n_class) OVER w / (count(*) OVER w * n_class), 6) AS weight FROM (
  SELECT symbol, label, count(*) AS n_class FROM labelled WHERE k < floor(n * 0.8) GROUP BY symbol, label)
WINDOW w AS (PARTITION BY symbol)"""))
def balanced_weights(spark, folder):
    train = L.chrono_split(frames.labelled(spark, folder)).filter("part = 'train'")
    return rounded(L.balanced_weights(train))


TOP10 = using("scored", body="""
SELECT symbol, round(close_usd, 6) AS close_usd, round(volatility_30d, 6) AS volatility_30d,
       round(return_30d, 6) AS return_30d, round(safety_score, 6) AS safety_score
FROM scored WHERE date = (SELECT max(date) FROM scored) ORDER BY scored.safety_score DESC, symbol LIMIT 10""")


@query("top10_safest", TOP10)
def top10_safest(spark, folder):
    return rounded(K.top_safest(frames.scored(spark, folder)))


@query("risk_scatter", using("scored", body="""
SELECT symbol, round(volatility_30d, 6) AS volatility_30d, round(safety_score, 6) AS safety_score
FROM scored WHERE date = (SELECT max(date) FROM scored)"""))
def risk_scatter(spark, folder):
    return rounded(K.risk_scatter(frames.scored(spark, folder)))


@query("compare_series", using("scored", body="""
SELECT symbol, date, round(close_usd, 6) AS close_usd, round(volatility_30d, 6) AS volatility_30d
FROM scored WHERE symbol IN ('BTCUSDT', 'B2USDT') ORDER BY symbol, date"""))
def compare_series(spark, folder):
    return rounded(K.compare_series(frames.scored(spark, folder), "BTCUSDT", "B2USDT"))


@query("top30_by_volume", using("scored", body="""
SELECT symbol, round(avg_volume_30d, 6) AS avg_volume_30d FROM scored
WHERE date = (SELECT max(date) FROM scored) AND symbol IN (
  SELECT symbol FROM scored GROUP BY symbol
  HAVING count(date) >= 0.6 * (SELECT count(DISTINCT date) FROM scored))
ORDER BY scored.avg_volume_30d DESC, symbol LIMIT 30"""))
def top30_by_volume(spark, folder):
    top = K.top_by_volume(frames.scored(spark, folder), min_coverage=0.6)
    return rounded(top.select("symbol", "avg_volume_30d"))


@query("leaderboard", using("scored", body="""
SELECT symbol, round(volume_usd, 6) AS volume_usd, round(return_30d, 6) AS return_30d FROM scored
WHERE date = (SELECT max(date) FROM scored) ORDER BY scored.return_30d DESC, symbol LIMIT 12"""))
def leaderboard(spark, folder):
    latest = K.leaderboard(frames.scored(spark, folder), "return_30d", 12)
    return rounded(latest.select("symbol", "volume_usd", "return_30d"))


@query("describe_scores", using("scored", body="\nUNION ALL\n".join(f"""
SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
       round(min({c}), 6) AS min, round(quantile_disc({c}, 0.25), 6) AS q25, round(quantile_disc({c}, 0.5), 6) AS q50,
       round(quantile_disc({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM scored"""
    for c in ("volatility_7d", "volatility_30d", "return_30d", "safety_score"))))
def describe_scores(spark, folder):
    stats = K.describe(frames.scored(spark, folder), ["volatility_7d", "volatility_30d", "return_30d", "safety_score"])
    return stats.select("measure", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"),
                        *[F.round(c, 6).alias(c) for c in ("min", "q25", "q50", "q75", "max")])
