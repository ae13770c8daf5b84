"""Normalisation, selection, joins and set operations over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.functions import guards
from tickerloom.operators import bars as B
from tickerloom.operators import returns as R
from tickerloom.operators import selection as S
from tickerloom.operators.labels import CLASSES
from tickerloom.sources import star

BAR_COLUMNS = "symbol, date, round(close, 6) AS close, volume"


@query("daily_bars", using("bars", body="""
SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
       volume, quote_asset_volume, number_of_trades FROM bars"""))
def daily_bars(spark, folder):
    return rounded(star.bars(spark, folder))


@query("filter_suffix", using("bars", body="SELECT symbol, date, round(close, 6) AS close, symbol LIKE '%USDT' AS is_usd FROM bars"))
def filter_suffix(spark, folder):
    both = frames.bars(spark, folder)
    usd = both.filter(B.is_usd()).withColumn("is_usd", F.lit(True))
    other = both.filter(~B.is_usd()).withColumn("is_usd", F.lit(False))
    return rounded(usd.unionByName(other).select("symbol", "date", "close", "is_usd"))


@query("filter_eq_project", using("bars", body="SELECT date, round(close, 6) AS btc_usd_price FROM bars WHERE symbol = 'BTCUSDT'"))
def filter_eq_project(spark, folder):
    return rounded(B.bridge_prices(frames.bars(spark, folder)))


@query("filter_isin", using("usd_bars", body="SELECT symbol, date, round(close_usd, 6) AS close_usd FROM usd_bars WHERE symbol IN ('BTCUSDT', 'B7USDT')"))
def filter_isin(spark, folder):
    chosen = frames.usd_bars(spark, folder).filter(F.col("symbol").isin("BTCUSDT", "B7USDT"))
    return rounded(chosen.select("symbol", "date", "close_usd"))


@query("filter_trailing_days", using("usd_bars", body="SELECT symbol, date, round(close_usd, 6) AS close_usd FROM usd_bars WHERE date >= (SELECT max(date) FROM usd_bars) - 30"))
def filter_trailing_days(spark, folder):
    return rounded(S.trailing_days(frames.usd_bars(spark, folder)).select("symbol", "date", "close_usd"))


@query("filter_latest_date", using("usd_bars", body="SELECT symbol, date, round(close_usd, 6) AS close_usd FROM usd_bars WHERE date = (SELECT max(date) FROM usd_bars)"))
def filter_latest_date(spark, folder):
    return rounded(S.at_latest_date(frames.usd_bars(spark, folder)).select("symbol", "date", "close_usd"))


@query("case_guard", """
SELECT event_id, CASE WHEN props_k = 0 THEN 0.0 ELSE round(value / props_k, 8) END AS guarded_ratio,
       CASE WHEN value <= 10 THEN 1e-9 ELSE round(value, 6) END AS floored
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS props_k FROM events)""")
def case_guard(spark, folder):
    events = star.table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    shifted = guards.positive_or(F.col("value") - 10, 1e-9)
    return events.select(
        "event_id",
        F.round(guards.ratio(F.col("value"), F.col("k")), 8).alias("guarded_ratio"),
        F.when(shifted == 1e-9, shifted).otherwise(F.round("value", 6)).alias("floored"),
    )


LAGGED = """
SELECT symbol, date, round(coalesce(lag(close_usd, 1) OVER w, 0.0), 6) AS prev_close_usd,
       round(coalesce(lag(close_usd, 30) OVER w, -1.0), 6) AS close_usd_30d_ago
FROM usd_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


@query("fill_per_column", using("usd_bars", body=LAGGED))
def fill_per_column(spark, folder):
    wide = R.with_returns(frames.usd_bars(spark, folder)).select("symbol", "date", "prev_close_usd", "close_usd_30d_ago")
    return rounded(guards.fill_columns(wide, {"prev_close_usd": 0.0, "close_usd_30d_ago": -1.0}))


@query("drop_null_keys", using("usd_bars", body="""
SELECT symbol, date, close_usd_30d_ago FROM (
  SELECT symbol, date, round(lag(close_usd, 30) OVER (PARTITION BY symbol ORDER BY date), 6) AS close_usd_30d_ago
  FROM usd_bars) WHERE close_usd_30d_ago IS NOT NULL AND date IS NOT NULL"""))
def drop_null_keys(spark, folder):
    wide = R.with_returns(frames.usd_bars(spark, folder)).select("symbol", "date", "close_usd_30d_ago")
    return rounded(guards.drop_null_keys(wide, ("close_usd_30d_ago", "date")))


@query("ensure_columns", using("usd_bars", body="""
SELECT symbol, date, round(volume_usd, 6) AS volume_usd, 0.0::DOUBLE AS btc_return FROM usd_bars"""))
def ensure_columns(spark, folder):
    padded = guards.ensure_columns(frames.usd_bars(spark, folder), {"volume_usd": 1.0, "btc_return": 0.0})
    return rounded(padded.select("symbol", "date", "volume_usd", "btc_return"))


@query("clip", using("analyzed", body="""
SELECT symbol, date, round(greatest(-0.5, least(5.0, daily_return)), 6) AS model_return,
       round(greatest(-0.2, least(0.2, daily_return)), 6) AS step_return,
       round(greatest(1e-9, close_usd), 6) AS price
FROM analyzed"""))
def clip(spark, folder):
    df = R.with_returns(frames.usd_bars(spark, folder))
    return rounded(
        df.select(
            "symbol",
            "date",
            guards.clip(F.col("daily_return"), -0.5, 5.0).alias("model_return"),
            guards.clip(F.col("daily_return"), -0.2, 0.2).alias("step_return"),
            F.greatest(F.lit(1e-9), "close_usd").alias("price"),
        )
    )


@query("series_quality_gate", using("usd_bars", body="""
SELECT symbol, date, round(close_usd, 6) AS close_usd FROM usd_bars WHERE symbol IN (
  SELECT symbol FROM usd_bars GROUP BY symbol
  HAVING count(*) >= 1000 AND stddev_pop(close_usd) / (avg(abs(close_usd)) + 1e-9) >= 0.32)"""))
def series_quality_gate(spark, folder):
    gated = S.series_quality_gate(frames.usd_bars(spark, folder), min_rows=1000, min_variation=0.32)
    return rounded(gated.select("symbol", "date", "close_usd"))


@query("usable_rows_gate", using("labelled", body="""
SELECT symbol, next_date, label FROM labelled WHERE symbol IN (
  SELECT symbol FROM labelled GROUP BY symbol HAVING count(*) >= 1300 AND count(DISTINCT label) >= 2)"""))
def usable_rows_gate(spark, folder):
    return S.usable_rows_gate(frames.labelled(spark, folder), min_rows=1300).select("symbol", "next_date", "label")


@query("anti_join_existing_usd", using("twin_bars", body="""
SELECT symbol, date, round(close, 6) AS close FROM twin_bars b WHERE symbol LIKE '%BTC' AND NOT EXISTS (
  SELECT 1 FROM twin_bars u WHERE u.symbol = regexp_replace(b.symbol, 'BTC$', 'USDT'))"""))
def anti_join_existing_usd(spark, folder):
    return rounded(B.without_usd_pair(frames.bars_with_twins(spark, folder)).select("symbol", "date", "close"))


@query("bridge_convert", using("bars", body="""
SELECT b.symbol, b.date, round(b.close * x.close, 6) AS close_usd, round(b.volume * x.close, 6) AS volume_usd
FROM bars b JOIN bars x ON x.symbol = 'BTCUSDT' AND x.date = b.date WHERE b.symbol LIKE '%BTC'"""))
def bridge_convert(spark, folder):
    bars = frames.bars(spark, folder)
    other = bars.filter(~B.is_usd())
    return rounded(B.bridge_convert(other, B.bridge_prices(bars)).select("symbol", "date", "close_usd", "volume_usd"))


@query("left_join_market_factor", using("usd_bars", body="""
SELECT symbol, date, round(coalesce(max(daily_return) FILTER (WHERE symbol = 'BTCUSDT') OVER (PARTITION BY date), 0.0), 6) AS btc_return
FROM (SELECT symbol, date, CASE WHEN prev IS NULL OR prev = 0 THEN 0.0 ELSE (close_usd - prev) / prev END AS daily_return
      FROM (SELECT symbol, date, close_usd, lag(close_usd) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM usd_bars))"""))
def left_join_market_factor(spark, folder):
    return rounded(frames.panel_input(spark, folder).select("symbol", "date", "btc_return"))


COVERED = """
SELECT symbol, count(date) AS n_days FROM usd_bars GROUP BY symbol
HAVING count(date) >= 0.6 * (SELECT count(DISTINCT date) FROM usd_bars)"""


@query("coverage_by_symbol", using("usd_bars", body=COVERED))
def coverage_by_symbol(spark, folder):
    return S.coverage(frames.usd_bars(spark, folder), 0.6)


@query("semi_join_coverage", using("usd_bars", body=f"""
SELECT symbol, date, round(close_usd, 6) AS close_usd FROM usd_bars
WHERE date = (SELECT max(date) FROM usd_bars) AND symbol IN (SELECT symbol FROM ({COVERED}))"""))
def semi_join_coverage(spark, folder):
    usd = frames.usd_bars(spark, folder)
    kept = S.semi_join_coverage(S.at_latest_date(usd), S.coverage(usd, 0.6))
    return rounded(kept.select("symbol", "date", "close_usd"))


@query("max_date", using("usd_bars", body="SELECT max(date) AS max_date FROM usd_bars"))
def max_date(spark, folder):
    return S.max_date(frames.usd_bars(spark, folder))


@query("count_distinct_symbols", using("usd_bars", body="SELECT count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates FROM usd_bars"))
def count_distinct_symbols(spark, folder):
    return S.distinct_counts(frames.usd_bars(spark, folder))


@query("series_cv", using("usd_bars", body="""
SELECT symbol, count(*) AS n_rows, round(stddev_pop(close_usd) / (avg(abs(close_usd)) + 1e-9), 6) AS cv
FROM usd_bars GROUP BY symbol"""))
def series_cv(spark, folder):
    return rounded(S.series_variation(frames.usd_bars(spark, folder)))


@query("union_usd", using("bars", body="""
SELECT symbol, date, round(close, 6) AS close_usd FROM bars WHERE symbol LIKE '%USDT'
UNION ALL
SELECT b.symbol, b.date, round(b.close * x.close, 6) FROM bars b JOIN bars x ON x.symbol = 'BTCUSDT' AND x.date = b.date
WHERE b.symbol LIKE '%BTC'"""))
def union_usd(spark, folder):
    bars = frames.bars(spark, folder)
    native = bars.filter(B.is_usd()).withColumns({"close_usd": F.col("close"), "volume_usd": F.col("volume")})
    converted = B.bridge_convert(bars.filter(~B.is_usd()), B.bridge_prices(bars))
    return rounded(B.union_usd(native, converted).select("symbol", "date", "close_usd"))


@query("dedup_key", using("bars", body="""
SELECT symbol, date, round(CASE WHEN date > (SELECT max(date) FROM bars) - 60 THEN close * 1.01 ELSE close END, 6) AS close, volume
FROM bars"""))
def dedup_key(spark, folder):
    monthly = frames.bars(spark, folder).select("symbol", "date", "close", "volume")
    recent = monthly.filter(F.col("date") > F.date_sub(S.max_date(monthly).scalar(), 60))
    daily = recent.withColumn("close", F.col("close") * 1.01)
    open_time = F.unix_millis(F.col("date").cast("timestamp"))
    both = monthly.withColumn("file_path", F.lit("/spot/monthly/x")).unionByName(
        daily.withColumn("file_path", F.lit("/spot/daily/x"))
    )
    both = both.withColumn("open_time", open_time)
    return rounded(B.dedup_key(both, B.candle_order()).select("symbol", "date", "close", "volume"))


@query("normalize_usd", using("twin_usd_bars", body="""
SELECT date, symbol, round(close, 6) AS close, round(volume, 6) AS volume, round(close_usd, 6) AS close_usd,
       round(volume_usd, 6) AS volume_usd FROM twin_usd_bars"""))
def normalize_usd(spark, folder):
    return rounded(B.normalize_usd(frames.bars_with_twins(spark, folder)))


@query("distinct_symbols", using("usd_bars", body="SELECT DISTINCT symbol FROM usd_bars ORDER BY symbol"))
def distinct_symbols(spark, folder):
    return frames.usd_bars(spark, folder).select("symbol").distinct().orderBy("symbol")


@query("future_dates", using("usd_bars", body="""
SELECT symbol, CAST(unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL 365 DAY, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT symbol, max(date) AS last FROM usd_bars GROUP BY symbol)"""))
def future_dates(spark, folder):
    last = frames.usd_bars(spark, folder).groupBy("symbol").agg(F.max("date").alias("last"))
    days = F.sequence(F.date_add("last", 1), F.date_add("last", 365))
    return last.select("symbol", F.explode(days).alias("date"))


@query("sort_series", using("usd_bars", body="SELECT symbol, date, round(close_usd, 6) AS close_usd FROM usd_bars ORDER BY symbol, date"))
def sort_series(spark, folder):
    return rounded(frames.usd_bars(spark, folder).select("symbol", "date", "close_usd")).orderBy("symbol", "date")


@query("label_distribution", using("labelled", body="""
SELECT symbol, count(*) FILTER (WHERE label = 'UP') AS n_up, count(*) FILTER (WHERE label = 'DOWN') AS n_down,
       count(*) FILTER (WHERE label = 'NEUTRAL') AS n_neutral FROM labelled GROUP BY symbol"""))
def label_distribution(spark, folder):
    from tickerloom.operators.labels import label_distribution as count_labels

    return count_labels(frames.labelled(spark, folder)).select("symbol", *[f"n_{c.lower()}" for c in CLASSES])
