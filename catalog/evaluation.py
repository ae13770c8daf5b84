"""Metrics of a deterministic predictor under walk-forward folds."""

from __future__ import annotations

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from pyspark.sql import functions as F
from tickerloom.operators import evaluation as V
from tickerloom.operators import ranking as K

TEST = """
, test AS MATERIALIZED (
  SELECT * FROM folded f WHERE part = 'test' AND EXISTS (
    SELECT 1 FROM (SELECT symbol, fold, count(DISTINCT label) FILTER (WHERE part = 'train') AS a,
                          count(DISTINCT label) FILTER (WHERE part = 'test') AS b FROM folded GROUP BY symbol, fold) u
    WHERE u.symbol = f.symbol AND u.fold = f.fold AND u.a >= 2 AND u.b >= 2)
), classes(c) AS (VALUES ('UP'), ('DOWN'), ('NEUTRAL')
), per_class AS MATERIALIZED (
  SELECT symbol, fold, c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS called,
         count(*) FILTER (WHERE label = c AND prediction = c) AS hits
  FROM test, classes GROUP BY symbol, fold, c
), per_class_f1 AS MATERIALIZED (
  SELECT symbol, fold, c, support,
         CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1
  FROM (SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0.0 END AS p,
                  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM per_class)
  WHERE support + called > 0
), f1 AS MATERIALIZED (
  SELECT symbol, fold, sum(f1 * support) / sum(support) AS f1_weighted, avg(f1) AS f1_macro
  FROM per_class_f1 GROUP BY symbol, fold
), acc AS MATERIALIZED (
  SELECT symbol, fold, coalesce(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)
           FILTER (WHERE label <> 'NEUTRAL' AND prediction <> 'NEUTRAL'), 0.5) AS dir_accuracy
  FROM test GROUP BY symbol, fold
), scores AS MATERIALIZED (
  SELECT symbol, fold, c, label = c AS pos,
         CASE c WHEN 'UP' THEN score_up WHEN 'DOWN' THEN score_down ELSE score_neutral END AS s FROM test, classes
), areas AS MATERIALIZED (
  SELECT p.symbol, p.fold, p.c, avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END) AS area
  FROM scores p JOIN scores q ON p.symbol = q.symbol AND p.fold = q.fold AND p.c = q.c AND p.pos AND NOT q.pos
  GROUP BY p.symbol, p.fold, p.c
), auc AS MATERIALIZED (
  SELECT k.symbol, k.fold, CASE WHEN count(a.area) = 3 THEN sum(a.area * k.support) / sum(k.support) ELSE 0.0 END AS auc_roc
  FROM per_class k LEFT JOIN areas a ON a.symbol = k.symbol AND a.fold = k.fold AND a.c = k.c GROUP BY k.symbol, k.fold
), fold_metrics AS MATERIALIZED (
  SELECT f1.symbol, CAST(f1.fold AS INT) AS fold, f1_weighted, f1_macro, dir_accuracy, auc_roc FROM f1
  JOIN acc ON acc.symbol = f1.symbol AND acc.fold = f1.fold JOIN auc ON auc.symbol = f1.symbol AND auc.fold = f1.fold
), metrics AS MATERIALIZED (
  SELECT m.symbol, f1_weighted, f1_macro, dir_accuracy, auc_roc, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mae, n_up, n_down, n_neutral,
         n_days, 'OK' AS status
  FROM (SELECT symbol, avg(f1_weighted) AS f1_weighted, avg(f1_macro) AS f1_macro, avg(dir_accuracy) AS dir_accuracy,
               avg(auc_roc) AS auc_roc FROM fold_metrics GROUP BY symbol) m
  JOIN (SELECT symbol, count(*) FILTER (WHERE label = 'UP') AS n_up, count(*) FILTER (WHERE label = 'DOWN') AS n_down,
               count(*) FILTER (WHERE label = 'NEUTRAL') AS n_neutral, count(*) + 31 AS n_days FROM labelled GROUP BY symbol) d
    ON d.symbol = m.symbol
)"""


def on_metrics(body: str) -> str:
    return using("folded", "usd_bars", body="\x00").replace("\n\x00", TEST + "\n" + body)


@query("baseline_predictor", using("labelled", body="""
SELECT symbol, next_date AS date, label, prediction, round(score_up, 6) AS score_up, round(score_down, 6) AS score_down,
       round(score_neutral, 6) AS score_neutral FROM labelled"""))
def baseline_predictor(spark, folder):
    rows = frames.predicted(spark, folder)
    return rounded(rows.select("symbol", F.col("next_date").alias("date"), "label", "prediction",
                               "score_up", "score_down", "score_neutral"))


def per_fold(name: str, columns: str, source: str):
    @query(name, on_metrics(f"SELECT symbol, CAST(fold AS INT) AS fold, {columns} FROM {source}"))
    def run(spark, folder):
        test = frames.folded(spark, folder).filter("part = 'test'")
        return rounded(getattr(V, name)(test, ["symbol", "fold"]))


per_fold("f1_scores", "round(f1_weighted, 6) AS f1_weighted, round(f1_macro, 6) AS f1_macro", "f1")
per_fold("directional_accuracy", "round(dir_accuracy, 6) AS dir_accuracy", "acc")
per_fold("auc_ovr_weighted", "round(auc_roc, 6) AS auc_roc", "auc")


@query("fold_mean", on_metrics("""
SELECT symbol, round(f1_weighted, 6) AS f1_weighted, round(f1_macro, 6) AS f1_macro,
       round(dir_accuracy, 6) AS dir_accuracy, round(auc_roc, 6) AS auc_roc FROM metrics"""))
def fold_mean(spark, folder):
    return rounded(V.fold_mean(V.fold_metrics(frames.folded(spark, folder))))


@query("symbol_metrics", on_metrics("""
SELECT symbol, round(f1_weighted, 6) AS f1_weighted, round(f1_macro, 6) AS f1_macro,
       round(dir_accuracy, 6) AS dir_accuracy, round(auc_roc, 6) AS auc_roc, rmse, mae, n_up, n_down, n_neutral, n_days,
       status FROM metrics"""))
def symbol_metrics(spark, folder):
    return rounded(frames.metrics(spark, folder))


@query("metric_summary", on_metrics("""
SELECT round(avg(f1_weighted), 6) AS avg_f1_w, round(quantile_disc(f1_weighted, 0.5), 6) AS med_f1_w,
       round(avg(f1_macro), 6) AS avg_f1_m, round(avg(dir_accuracy), 6) AS avg_dir,
       round(quantile_disc(dir_accuracy, 0.5), 6) AS med_dir, round(avg(auc_roc), 6) AS avg_auc,
       0.0::DOUBLE AS avg_rmse, 0.0::DOUBLE AS avg_mae FROM metrics"""))
def metric_summary(spark, folder):
    return rounded(V.metric_summary(frames.metrics(spark, folder)))


@query("threshold_counts", on_metrics("""
SELECT count(*) FILTER (WHERE f1_weighted >= 0.5) AS f1_good, count(*) FILTER (WHERE dir_accuracy >= 0.5) AS dir_50,
       count(*) FILTER (WHERE dir_accuracy >= 0.52) AS dir_52, count(*) FILTER (WHERE dir_accuracy >= 0.55) AS dir_55,
       count(*) FILTER (WHERE auc_roc >= 0.55) AS auc_good FROM metrics"""))
def threshold_counts(spark, folder):
    return V.threshold_counts(frames.metrics(spark, folder))


@query("filtered_out_count", on_metrics("""
SELECT n_total, n_eval, n_total - n_eval AS n_filtered FROM (SELECT count(DISTINCT symbol) AS n_total FROM usd_bars),
  (SELECT count(*) AS n_eval FROM metrics)"""))
def filtered_out_count(spark, folder):
    return V.filtered_out_count(frames.usd_bars(spark, folder), frames.metrics(spark, folder))


@query("top15_by_metric", on_metrics("""
SELECT 'f1_weighted' AS metric, symbol, round(f1_weighted, 6) AS value FROM (
  SELECT * FROM metrics ORDER BY f1_weighted DESC, symbol LIMIT 15)
UNION ALL
SELECT 'dir_accuracy', symbol, round(dir_accuracy, 6) FROM (
  SELECT * FROM metrics ORDER BY dir_accuracy DESC, symbol LIMIT 15)"""))
def top15_by_metric(spark, folder):
    metrics = frames.metrics(spark, folder)
    best = [
        K.top_by(metrics, m, 15).select(F.lit(m).alias("metric"), "symbol", F.col(m).alias("value"))
        for m in ("f1_weighted", "dir_accuracy")
    ]
    return rounded(best[0].unionByName(best[1]))
