"""Shapes of physical plans that matter on large inputs, and results when one key owns a third of the rows."""

import datetime as dt

from pyspark.sql import functions as F
from test_series import prices_of

from tickerloom.learning.forecast import rollout_state
from tickerloom.operators import bars as B
from tickerloom.operators import dialogue as G
from tickerloom.operators import portfolio as P
from tickerloom.operators.features import feature_frame
from tickerloom.operators.labels import with_label_inputs
from tickerloom.operators.returns import join_market_factor, market_factor, scored_series, with_returns
from tickerloom.operators.selection import at_latest_date, trailing_days
from tickerloom.sources.payloads import source_fallback
from tickerloom.workspace import stage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def series_stage(usd):
    factor = market_factor(with_returns(usd.filter("symbol = 'BTCUSDT'")))
    return with_label_inputs(feature_frame(join_market_factor(scored_series(usd), factor)))


def test_series_stage_shuffles_the_bars_once(spark, usd_series):
    usd = stage(usd_series({"BTCUSDT": prices_of(60), "A": prices_of(60, 2)}).drop("btc_return"), "usd")
    plan = plan_of(series_stage(usd))
    by_symbol = [line for line in plan.split("\n") if "Exchange hashpartitioning(symbol" in line]
    assert len(by_symbol) == 2  # the bars, and the one symbol the market return is taken from
    assert plan.count("Exchange") == 3  # the third is the broadcast of that return


def test_stored_series_are_pruned_and_filtered_at_the_scan(spark, usd_series):
    usd = usd_series({"BTCUSDT": prices_of(60), "A": prices_of(60, 2)}).drop("btc_return")
    series = stage(series_stage(usd), "series")
    scan = next(line for line in plan_of(rollout_state(series)).split("\n") if "FileScan" in line)
    assert "safety_score" not in scan and "lag14#" not in scan and "GreaterThanOrEqual(n_rows" in scan
    newest = plan_of(at_latest_date(series).select("symbol", "safety_score"))
    assert "Exchange hashpartitioning" not in newest and "macd" not in newest


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    day = dt.date(2020, 1, 1)
    rows = [("HOT", day, float(k % 100)) for k in range(5000)] + [(f"S{k}", day, 1.0) for k in range(10000)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double").repartition(4)
    kept = B.dedup_key(df, [F.col("close").alias("_c")])
    assert kept.count() == 10001 and kept.filter("symbol = 'HOT'").first().close == 0.0
    log = spark.createDataFrame([(0, "add", 1)] + [(k, "update", 1) for k in range(1, 3000)], "seq long, op string, id long")
    log = log.withColumns({"coin": F.lit("A"), "qty": F.col("seq").cast("double"), "buy_price": F.lit(1.0), "added_at": F.current_timestamp()})
    assert [r.qty for r in P.positions_current(log).collect()] == [2999.0]
    assert "partial_max_by" in plan_of(P.positions_current(log))


def test_long_conversations_are_not_gathered(spark):
    turns = [(1, k, "user", f"t{k}") for k in range(4000)] + [(c, 0, "user", "x") for c in range(2, 2000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    contents = G.prompt_assembly(df, F.lit("C"))
    plan = plan_of(contents)
    assert "Window" not in plan and "collect_list" not in plan
    assert contents.count() == len(turns)
    assert contents.filter("text LIKE 'C%'").count() == 1999


def test_fallback_keeps_all_rows_of_a_hot_missing_key(spark):
    primary = spark.createDataFrame([("a", 1)], "symbol string, x long")
    secondary = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("symbol"), F.col("id").alias("x"))
    assert source_fallback(primary, secondary, "symbol").count() == 3001


def test_trailing_window_prunes_years(spark):
    rows = [("A", dt.date(2018 + k, 6, 1), 2018 + k) for k in range(6)]
    stored = stage(spark.createDataFrame(rows, "symbol string, date date, year int"), "years", ["year"])
    recent = trailing_days(stored, 30)
    assert [r.date.year for r in recent.collect()] == [2023]
    assert "PartitionFilters: [isnotnull(year" in recent._jdf.queryExecution().toString()
