"""File streams of candles and price events.

No stream keeps state. Each micro-batch is folded to one row per key and added to a tiered table, which knows the batches it
has, so a batch that is repeated after a failure counts once. Folders are merged as they become many. The current table is an
aggregation over the folders that gives the same rows for any cut of the events into batches, in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.schemas import CANDLE_FILE
from tickerloom.sources.candles import label_candles
from tickerloom.streaming.tiers import Tiers
from tickerloom.workspace import settle


def stream_klines(spark: SparkSession, path: str) -> DataFrame:
    """Candle files as they arrive, labelled with symbol and date.

    Overlaps are not removed here: a stateful duplicate filter would send all copies of a key to one task and could
    only keep the first, while the daily file should win. Each micro-batch is folded by ``clean_candles`` instead,
    which combines on the map side, and so is the table of all batches.
    """
    reader = settle(spark).readStream.schema(CANDLE_FILE).option("header", "false")
    raw = reader.option("recursiveFileLookup", "true").csv(path).select("*", F.col("_metadata.file_path").alias("file_path"))
    return label_candles(raw)


FIRST, LAST = "first_event", "last_event"


def partial_bars(events: DataFrame) -> DataFrame:
    """Price events ``symbol, ts, price, event_id`` of one batch as daily bars that can still be merged: open and close keep
    the time and id of their event."""
    event = F.struct("ts", "event_id", "price")
    return events.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.min(event).alias(FIRST), F.max("price").alias("high"), F.min("price").alias("low"), F.max(event).alias(LAST),
        F.count(F.lit(1)).alias("n_events"),
    )


def combined_bars(parts: DataFrame) -> DataFrame:
    """Partial bars of several batches as partial bars, one per symbol and day."""
    return parts.groupBy("symbol", "date").agg(
        F.min(FIRST).alias(FIRST), F.max("high").alias("high"), F.min("low").alias("low"), F.max(LAST).alias(LAST),
        F.sum("n_events").alias("n_events"),
    )


def merged_bars(parts: DataFrame) -> DataFrame:
    """Daily open, high, low, close and count from the partial bars of all batches. Late events correct their bar whenever
    they come; nothing is dropped and no state is kept."""
    return parts.groupBy("symbol", "date").agg(
        F.min(FIRST)["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max(LAST)["price"].alias("close"), F.sum("n_events").alias("n_events"),
    )


def latest_price(events: DataFrame) -> DataFrame:
    """Newest price per symbol of one batch of events, or of the results of several batches."""
    newest = F.max(F.struct("ts", "event_id", "price")).alias("_n")
    return events.groupBy("symbol").agg(newest).select("symbol", "_n.price", "_n.ts", "_n.event_id")


def drain(
    stream: DataFrame,
    path: str,
    mode: str = "append",
    fold: Callable[[DataFrame], DataFrame] | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    fan_in: int = 8,
) -> StreamingQuery:
    """Run a stream over everything available now and add each micro-batch, folded, to the tiered table at ``path``. ``merge``
    folds what several batches left to the same columns; with it the table stays in few folders."""
    table = Tiers(path, merge, fan_in)

    def write(batch: DataFrame, number: int) -> None:
        table.add(fold(batch) if fold else batch, number)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def batches(spark: SparkSession, path: str) -> DataFrame:
    return Tiers(path).read(spark)
