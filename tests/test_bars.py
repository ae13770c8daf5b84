import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions.calendar import epoch_to_date
from tickerloom.operators import bars as B
from tickerloom.operators.returns import market_factor
from tickerloom.sources import candles as N
from tickerloom.sources import payloads as P
from tickerloom.sources import star
from tickerloom.sources import tables as T
from tickerloom.workspace import fresh_path, stage

DAY = dt.date(2020, 1, 1)


def bar_rows(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date date, close double, volume double")


def candle_line(moment, close, volume=2.0):
    return f"{moment},1.0,{close + 1},0.5,{close},{volume},0,10.0,3,0.0,0.0,0\n"


def write_candles(root, name, lines):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.writelines(lines)


def test_scan_reads_tree_and_daily_file_wins(spark, tmp_path):
    ms, us = 1577836800000, 1577923200000000  # 2020-01-01 and, in microseconds, 2020-01-02
    write_candles(str(tmp_path), "monthly/klines/BTCUSDT/1d/BTCUSDT-1d-2020-01.csv", [candle_line(ms, 10.0), candle_line(us, 11.0)])
    write_candles(str(tmp_path), "daily/klines/BTCUSDT/1d/BTCUSDT-1d-2020-01-02.csv", [candle_line(us, 12.0)])
    write_candles(str(tmp_path), "daily/klines/odd.csv", [candle_line(us, 99.0)])
    rows = N.scan_klines(spark, str(tmp_path))
    assert rows.count() == 4
    assert N.unnamed_rows(rows).first()[0] == 1
    kept = {(r.symbol, r.date): r.close for r in N.clean_candles(rows).collect()}
    assert kept == {("BTCUSDT", DAY): 10.0, ("BTCUSDT", dt.date(2020, 1, 2)): 12.0}


def test_malformed_line_keeps_the_file_readable(spark, tmp_path):
    write_candles(str(tmp_path), "m/AUSDT-1d-2020-01.csv", [candle_line(1577836800000, 10.0), "x,y\n"])
    clean = N.clean_candles(N.scan_klines(spark, str(tmp_path))).collect()
    assert [r.close for r in clean] == [10.0]
    kept = N.scan_klines(spark, str(tmp_path), malformed="bad_line")
    assert [r.bad_line for r in kept.filter("bad_line IS NOT NULL").collect()] == ["x,y"]
    assert N.scan_klines(spark, str(tmp_path), "DROPMALFORMED").select("symbol", "open_time", "close").na.drop().count() == 1


def test_epoch_units(spark):
    df = spark.createDataFrame([(1577836800000,), (1577836800000000,), (10**14,)], "t long")
    assert [r[0] for r in df.select(epoch_to_date(F.col("t"))).collect()] == [DAY, DAY, dt.date(5138, 11, 16)]


def test_dedup_is_the_same_for_any_layout(spark):
    rows = [("A", DAY, float(v), f"/spot/{kind}/f{v}", 1, 1.0) for v in range(50) for kind in ("monthly", "daily")]
    schema = "symbol string, date date, close double, file_path string, open_time long, volume double"
    for order, parts in ((rows, 1), (rows[::-1], 7), (sorted(rows, key=lambda r: r[2] % 7), 3)):
        df = spark.createDataFrame(order, schema).repartition(parts)
        kept = B.dedup_key(df, B.candle_order()).collect()
        assert len(kept) == 1 and kept[0].close == 0.0 and "/daily/" in kept[0].file_path
        assert kept[0].asDict().keys() == set(df.columns)


def test_dedup_combines_before_the_shuffle(spark):
    df = bar_rows(spark, [("A", DAY, 1.0, 1.0)] * 10)
    plan = B.dedup_key(df, [F.col("close").alias("_c")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_normalize(spark):
    bars = bar_rows(
        spark,
        [
            ("BTCUSDT", DAY, 100.0, 1.0),
            ("ETHUSDT", DAY, 10.0, 2.0),
            ("ETHBTC", DAY, 0.1, 3.0),
            ("XYZBTC", DAY, 0.5, 4.0),
            ("XYZBTC", dt.date(2020, 1, 2), 0.5, 4.0),
            ("XYZEUR", DAY, 7.0, 1.0),
        ],
    )
    got = {r.symbol: (r.close_usd, r.volume_usd) for r in B.normalize_usd(bars).collect()}
    assert got == {"BTCUSDT": (100.0, 1.0), "ETHUSDT": (10.0, 2.0), "XYZBTC": (50.0, 400.0)}
    loose = {r.symbol for r in B.normalize_usd(bars, match="symbol", convert_all=True).collect()}
    assert loose == {"BTCUSDT", "ETHUSDT", "ETHBTC", "XYZBTC", "XYZEUR"}
    stored = bars.withColumn("side", B.quote_side())
    assert {r.symbol for r in B.normalize_usd(stored).collect()} == set(got)


def test_optional_source_and_fallback(spark):
    absent = T.optional_source(spark, fresh_path(spark, "none"), "symbol string, x int")
    assert absent.count() == 0 and absent.columns == ["symbol", "x"]
    primary = spark.createDataFrame([("a", 1)], "symbol string, x int")
    secondary = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "symbol string, x int")
    got = sorted(tuple(r) for r in P.source_fallback(primary, secondary, "symbol").collect())
    assert got == [("a", 1), ("b", 3), ("b", 4)]
    assert P.source_fallback(absent, secondary, "symbol").count() == 3


def test_stage_and_matrix_round_trip(spark):
    df = spark.createDataFrame([("a", 1.5, None), ("b", -2.25, 0.1)], "symbol string, a double, b double")
    assert sorted(stage(df, "t").collect()) == sorted(df.collect())
    path = fresh_path(spark, "csv")
    T.write_matrix_csv(df, path)
    assert sorted(T.read_matrix_csv(spark, path, "symbol", ["a", "b"]).collect()) == sorted(df.collect())


def test_payloads(spark):
    one = lambda text: spark.createDataFrame([(text,)], "p string")
    listing = '[{"id":"x","symbol":"X","current_price":1.5,"sparkline_in_7d":{"price":[1.0,2.0]}},{"id":"y"}]'
    rows = P.market_records(one(listing), "p").collect()
    assert [(r.coin_id, r.price_usd) for r in rows] == [("x", 1.5), ("y", None)]
    assert rows[0].sparkline.price == [1.0, 2.0] and rows[1].rank is None
    stats = P.global_stats(one('{"data":{"total_market_cap":{"usd":5}}}'), "p").first()
    assert stats.total_market_cap == 5 and stats.btc_dominance == 0
    assert P.global_stats(one("broken"), "p").first().total_volume_24h == 0
    index = P.sentiment_index(one('{"data":[{"value":"31","value_classification":"Fear","timestamp":"9"}]}'), "p").first()
    assert (index.value, index.label, len(index.history)) == (31, "Fear", 1)
    empty = P.sentiment_index(one('{"data":[]}'), "p").first()
    assert (empty.value, empty.label, empty.history) == (50, "Neutral", [])
    uneven = P.parallel_history(one('{"prices":[[0,1.0],[86400000,2.0]],"total_volumes":[[0,5.0]]}'), "p").collect()
    assert [(r.date.day, r.price, r.volume) for r in uneven] == [(1, 1.0, None), (2, 2.0, None)]
    candles = P.positional_candles(one('[[0,"1","2","0.5","1.5","9"],[0,"1"]]'), "p").collect()
    assert [(r.price, r.volume) for r in candles] == [(1.5, 9.0)]
    news = P.news_articles(one('{"results":[{"title":"T","votes":{"positive":1,"important":3},"currencies":[{"code":"A"}]}]}'), "p").first()
    assert (news.url, news.source, news.sentiment, news.is_hot, news.currencies) == ("#", "Unknown", "bullish", True, ["A"])


def test_repeated_days_of_the_bridge_do_not_multiply_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [("BTCUSDT", day, 100.0, 1.0), ("BTCUSDT", day, 90.0, 1.0), ("XBTC", day, 2.0, 3.0)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    got = [r for r in B.normalize_usd(bars).collect() if r.symbol == "XBTC"]
    assert [(r.close_usd, r.volume_usd) for r in got] == [(200.0, 300.0)]
    scored = spark.createDataFrame([("BTCUSDT", day, 0.1), ("BTCUSDT", day, 0.2), ("XBTC", day, 0.3)], "symbol string, date date, daily_return double")
    assert [tuple(r) for r in market_factor(scored).collect()] == [(day, 0.2)]


def test_only_trades_of_the_first_and_last_order_are_sorted(spark, tmp_path, monkeypatch):
    """All other figures of a bar come from hash tables, and ends that share an order are told apart by the rest of the key."""
    rng = np.random.default_rng(5)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    trades = pd.DataFrame({k: rng.integers(1, m, 400) for k, m in zip(keys, (12, 3, 5, 3, 900, 9))}).astype({keys[4]: float, keys[5]: float})
    trades["l_orderkey"] = trades["l_orderkey"].astype("Int64").mask(rng.random(400) < 0.02)
    trades["l_shipdate"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 6, 400), "D")
    trades["l_shipdate"] = trades["l_shipdate"].astype("datetime64[us]")
    parts = pd.DataFrame({"p_partkey": [1, 2, 3, 4], "p_brand": ["Brand#1", "Brand#2", "Brand#2", "Brand#22"]})
    for name, table in (("lineitem", trades), ("part", parts)):
        table.to_parquet(tmp_path / f"{name}.parquet")
    seen = []
    monkeypatch.setattr(star, "stage", lambda df, name: seen.append(df) or stage(df, name))
    got = {(r.symbol, r.date): r for r in star.bars(spark, str(tmp_path)).collect()}
    assert all("SortAggregate" not in df._jdf.queryExecution().toString() for df in seen) and len(seen) == 1
    want = trades.merge(parts, left_on="l_partkey", right_on="p_partkey")
    want["px"] = (want["l_extendedprice"] / want["l_quantity"]) ** 0.25
    symbols = {"Brand#1": "BTCUSDT", "Brand#2": "B2USDT", "Brand#22": "B22BTC"}
    groups = want.groupby(["p_brand", "l_shipdate"])
    assert len(got) == len(groups)
    for (brand, day), rows in groups:
        bar, rows = got[symbols[brand], day.date()], rows.sort_values(keys, na_position="first")
        prices = rows["px"].to_list()
        assert (bar.open, bar.close) == pytest.approx((prices[0], prices[-1]))
        assert (bar.high, bar.low, bar.volume) == pytest.approx((max(prices), min(prices), rows["l_quantity"].sum()))
        assert bar.quote_asset_volume == pytest.approx(rows["l_extendedprice"].sum()) and bar.number_of_trades == len(rows)
