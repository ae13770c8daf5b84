"""Streams over the given tables, drained with everything available and compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import SQL, query, rounded
from catalog.storage import candle_tree
from tickerloom.sources import candles as N
from tickerloom.sources.star import table
from tickerloom.streaming import ingest as I
from tickerloom.workspace import fresh_path


def price_events(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


@query("stream_klines", SQL["scan_klines"])
def stream_klines(spark, folder):
    root = candle_tree(spark, folder)
    out = fresh_path(spark, "incoming")
    I.drain(I.stream_klines(spark, root), out, fold=N.clean_candles, merge=N.clean_candles)
    clean = N.clean_candles(I.batches(spark, out))
    return rounded(clean.select("symbol", "date", "open", "high", "low", "close", "volume", "quote_asset_volume",
                                "number_of_trades"))


@query("stream_daily_bars", """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date, min_by(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high,
       min(value) AS low, max_by(value, struct_pack(a := ts, b := event_id)) AS close, count(*) AS n_events
FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def stream_daily_bars(spark, folder):
    path = fresh_path(spark, "daily_bars")
    I.drain(price_events(spark, folder), path, fold=I.partial_bars, merge=I.combined_bars)
    return I.merged_bars(I.batches(spark, path))


@query("stream_latest_price", """
SELECT event_type AS symbol, max_by(value, struct_pack(a := ts, b := event_id)) AS price FROM events GROUP BY event_type""")
def stream_latest_price(spark, folder):
    path = fresh_path(spark, "latest_price")
    I.drain(price_events(spark, folder), path, "append", I.latest_price, I.latest_price)
    return I.latest_price(I.batches(spark, path)).select("symbol", "price")
