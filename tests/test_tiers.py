import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.sources.candles import clean_candles
from tickerloom.streaming import ingest as I
from tickerloom.streaming.tiers import Tiers
from tickerloom.workspace import fresh_path

SCHEMA = "symbol string, ts timestamp, price double, event_id long"
START = dt.datetime(2024, 1, 1)


def events_of(spark, seed, n=40):
    rng = random.Random(seed)
    rows = [(rng.choice("ABC"), START + dt.timedelta(hours=rng.randint(0, 90)), float(rng.randint(1, 50)), seed * 1000 + k) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def result(spark, path):
    return sorted(map(tuple, I.merged_bars(Tiers(path).read(spark)).collect()))


def test_folders_stay_few_and_the_table_the_same(spark):
    path, plain = fresh_path(spark, "tiers"), fresh_path(spark, "plain")
    tiered, flat = Tiers(path, I.combined_bars, fan_in=3), Tiers(plain)
    for number in range(13):
        rows = I.partial_bars(events_of(spark, number))
        tiered.add(rows, number)
        flat.add(rows, number)
    entries = tiered.entries(spark)
    assert [(e.tier, e.first, e.last) for e in entries] == [(2, 0, 8), (1, 9, 11), (0, 12, 12)]
    assert len(flat.entries(spark)) == 13 and result(spark, path) == result(spark, plain)
    whole = I.partial_bars(events_of(spark, 0))
    for number in range(1, 13):
        whole = whole.unionByName(I.partial_bars(events_of(spark, number)))
    assert result(spark, path) == sorted(map(tuple, I.merged_bars(whole).collect()))
    # folders out of use are gone: those of the table and of the two versions before it are left
    assert len(os.listdir(f"{path}/parts")) <= 8 and len(os.listdir(f"{path}/manifest")) <= 4


def test_repeated_and_late_batches(spark):
    path = fresh_path(spark, "repeated")
    table = Tiers(path, I.combined_bars, fan_in=2)
    for number in (0, 1, 1, 3, 0, 2, 3):  # 1 and 0 come again, the first after it was merged; 2 comes late
        table.add(I.partial_bars(events_of(spark, number)), number)
    other = fresh_path(spark, "once")
    for number in range(4):
        Tiers(other).add(I.partial_bars(events_of(spark, number)), number)
    # batch 2 lies between others and still counts
    assert result(spark, path) == result(spark, other)


@pytest.mark.parametrize("at", [0, 1])
def test_crash_while_merging(spark, monkeypatch, at):
    """The merge fails before or after its folder is written; the table is the old one, and the repeated batch ends the merge."""
    path = fresh_path(spark, "crash")
    table = Tiers(path, I.combined_bars, fan_in=2)
    table.add(I.partial_bars(events_of(spark, 0)), 0)
    publish, calls = Tiers._publish, []

    def failing(self, spark, entries):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        publish(self, spark, entries)

    def broken(parts):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        if at:
            monkeypatch.setattr(Tiers, "_publish", failing)
            table.add(I.partial_bars(events_of(spark, 1)), 1)
        else:
            Tiers(path, broken, fan_in=2).add(I.partial_bars(events_of(spark, 1)), 1)
    monkeypatch.undo()
    assert [e.tier for e in table.entries(spark)] == [0, 0]
    before = result(spark, path)
    table.add(I.partial_bars(events_of(spark, 1)), 1)
    assert result(spark, path) == before
    table.add(I.partial_bars(events_of(spark, 2)), 2)
    assert [e.tier for e in table.entries(spark)] == [1] or [e.tier for e in table.entries(spark)] == [1, 0]


def test_readers_keep_their_version(spark):
    path = fresh_path(spark, "readers")
    table = Tiers(path, I.latest_price, fan_in=2)
    table.add(I.latest_price(events_of(spark, 0)), 0)
    early = table.read(spark)
    n = early.count()
    table.add(I.latest_price(events_of(spark, 1)), 1)
    assert early.count() == n
    want = events_of(spark, 0).unionByName(events_of(spark, 1))
    assert sorted(I.latest_price(table.read(spark)).collect()) == sorted(I.latest_price(want).collect())
    with pytest.raises(FileNotFoundError):
        Tiers(fresh_path(spark, "none")).read(spark)


def test_a_stream_of_many_batches(spark):
    source, path = fresh_path(spark, "source"), fresh_path(spark, "sink")
    for k in range(7):
        events_of(spark, k).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    I.drain(stream, path, fold=I.partial_bars, merge=I.combined_bars, fan_in=2)
    assert len(Tiers(path).entries(spark)) <= 3
    want = I.merged_bars(I.partial_bars(spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)))
    assert result(spark, path) == sorted(map(tuple, want.collect()))


def test_candles_fold_again(spark):
    """``clean_candles`` gives the same rows over parts of its own results."""
    columns = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_asset_volume double, number_of_trades long, taker_buy_base_asset_volume double, taker_buy_quote_asset_volume double, ignore string, file_path string, symbol string, date date"
    rows = [(0, 1.0, 2.0, 0.5, float(k), 5.0, 1, 1.0, 1, 1.0, 1.0, "0", f"/x/AUSDT-1d-2024-01{'-01' if k % 2 else ''}.csv", "AUSDT", dt.date(2024, 1, 1 + k // 3)) for k in range(9)]
    whole = spark.createDataFrame(rows, columns)
    parts = clean_candles(whole.filter("close < 4")).unionByName(clean_candles(whole.filter("close >= 4")))
    assert sorted(clean_candles(parts).collect()) == sorted(clean_candles(whole).collect())
    assert clean_candles(whole).select(F.count_distinct("date")).first()[0] == 3
