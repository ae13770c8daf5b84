"""Candle files, stage tables and feed payloads, written by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.functions.calendar import epoch_to_date
from tickerloom.operators import selection as S
from tickerloom.sources import candles as N
from tickerloom.sources import payloads as P
from tickerloom.sources import star
from tickerloom.sources import tables as T
from tickerloom.workspace import fresh_path

OVERLAP = 60


def epoch():
    """Milliseconds in even years, microseconds in odd ones."""
    moment = F.col("date").cast("timestamp")
    return F.when(F.year("date") % 2 == 0, F.unix_millis(moment)).otherwise(F.unix_micros(moment))


_TREES = {}


def candle_tree(spark, folder):
    """Candle files of a folder, written once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TREES:
        _TREES[key] = write_candle_tree(spark, folder)
    return _TREES[key]


def write_candle_tree(spark, folder):
    """Monthly files for everything, daily files with changed closes for the newest days, one misnamed folder."""
    root = fresh_path(spark, "spot")
    bars = frames.bars(spark, folder).withColumn("open_time", epoch())
    month = F.concat("symbol", F.lit("-1d-"), F.date_format("date", "yyyy"))
    N.write_klines(bars, f"{root}/monthly/klines", month)
    recent = bars.filter(F.col("date") > F.date_sub(S.max_date(bars).scalar(), OVERLAP))
    N.write_klines(recent.withColumn("close", F.col("close") * 1.01), f"{root}/daily/klines", month)
    N.write_klines(recent, f"{root}/daily/stray", F.lit("notes"))
    return root


@query("scan_klines", using("bars", body=f"""
SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(CASE WHEN date > (SELECT max(date) FROM bars) - {OVERLAP} THEN close * 1.01 ELSE close END, 6) AS close,
       volume, quote_asset_volume, number_of_trades FROM bars"""))
def scan_klines(spark, folder):
    clean = N.clean_candles(N.scan_klines(spark, candle_tree(spark, folder)))
    return rounded(clean.select("symbol", "date", "open", "high", "low", "close", "volume", "quote_asset_volume",
                                "number_of_trades"))


@query("source_path", using("bars", body=f"""
SELECT 'monthly' AS kind, symbol, count(*) AS n FROM bars GROUP BY symbol
UNION ALL
SELECT 'daily', symbol, count(*) FROM bars WHERE date > (SELECT max(date) FROM bars) - {OVERLAP} GROUP BY symbol
UNION ALL
SELECT 'daily', 'none', count(*) FROM bars WHERE date > (SELECT max(date) FROM bars) - {OVERLAP}"""))
def source_path(spark, folder):
    rows = N.scan_klines(spark, candle_tree(spark, folder))
    kind = F.regexp_extract("file_path", "/spot/(monthly|daily)/", 1)
    return rows.groupBy(kind.alias("kind"), F.coalesce("symbol", F.lit("none")).alias("symbol")).agg(
        F.count(F.lit(1)).alias("n")
    )


PATHS = r"""
SELECT '/spot/monthly/klines/' || symbol || '/1d/' || symbol || '-1d-' || strftime(date, '%Y-%m') || '.csv' AS path
FROM bars
UNION ALL SELECT '/spot/monthly/klines/' || symbol || '-120m-' || strftime(date, '%Y-%m') || '.csv' FROM bars
UNION ALL SELECT url FROM pages"""


@query("symbol_from_path", using("bars", body=rf"""
SELECT path, nullif(regexp_extract(coalesce(nullif(regexp_extract(path, '.*/[^/=]+=([^/]+)/[^/]*$', 1), ''),
  regexp_extract(path, '([^/]*)$', 1)), '([^/=]+)-(\d+[a-zA-Z])-', 1), '') AS symbol FROM ({PATHS})"""))
def symbol_from_path(spark, folder):
    month = F.date_format("date", "yyyy-MM")
    named = frames.bars(spark, folder).select(
        F.concat(F.lit("/spot/monthly/klines/"), "symbol", F.lit("/1d/"), "symbol", F.lit("-1d-"), month, F.lit(".csv")).alias("path")
    )
    longer = frames.bars(spark, folder).select(
        F.concat(F.lit("/spot/monthly/klines/"), "symbol", F.lit("-120m-"), month, F.lit(".csv")).alias("path")
    )
    both = named.unionByName(longer).unionByName(star.table(spark, folder, "pages").select(F.col("url").alias("path")))
    return both.withColumn("symbol", N.symbol_from_path(F.col("path")))


@query("epoch_to_date", using("bars", body="SELECT symbol, date FROM bars"))
def to_date(spark, folder):
    coded = frames.bars(spark, folder).select("symbol", epoch().alias("open_time"))
    return coded.select("symbol", epoch_to_date(F.col("open_time")).alias("date"))


@query("write_parquet", using("scored", body="""
SELECT symbol, date, round(close_usd, 6) AS close_usd, round(safety_score, 6) AS safety_score, CAST(year(date) AS INT) AS year
FROM scored"""))
def write_parquet(spark, folder):
    path = fresh_path(spark, "scored_data")
    scored = rounded(frames.scored(spark, folder).select("symbol", "date", "close_usd", "safety_score"))
    T.write_parquet(scored.withColumn("year", F.year("date")), path, ["year"])
    return T.read_parquet(spark, path)


@query("read_parquet", using("scored", body="""
SELECT symbol, date, round(close_usd, 6) AS close_usd FROM scored WHERE close_usd >= 10"""))
def read_parquet(spark, folder):
    path = fresh_path(spark, "scored_data")
    T.write_parquet(frames.scored(spark, folder), path)
    return rounded(T.read_parquet(spark, path).filter("close_usd >= 10").select("symbol", "date", "close_usd"))


@query("optional_source", using("bars", body="SELECT symbol, date, round(close, 6) AS close FROM bars"))
def optional_source(spark, folder):
    bars = frames.bars(spark, folder).select("symbol", "date", "close")
    absent = T.optional_source(spark, fresh_path(spark, "absent"), bars.schema)
    return rounded(bars.unionByName(absent))


@query("source_fallback", using("bars", body="""
SELECT symbol, date, round(CASE WHEN symbol < 'B2' THEN close ELSE close * 1.01 END, 6) AS close FROM bars"""))
def source_fallback(spark, folder):
    bars = frames.bars(spark, folder).select("symbol", "date", "close")
    primary = bars.filter(F.col("symbol") < "B2")
    return rounded(P.source_fallback(primary, bars.withColumn("close", F.col("close") * 1.01), "symbol"))


def month_of(df):
    """Payloads hold one symbol and month, at most 31 entries; together they cover all bars."""
    return df.withColumns({"month": F.trunc("date", "month"), "n": F.day("date").cast("bigint")})


@query("json_records", using("bars", body="""
SELECT 'coin-' || symbol AS coin_id, symbol, NULL::VARCHAR AS name, close AS price_usd, volume AS volume_24h,
       day(date) AS rank FROM bars"""))
def json_records(spark, folder):
    record = F.struct(
        F.concat(F.lit("coin-"), "symbol").alias("id"), F.col("symbol"), F.col("close").alias("current_price"),
        F.col("volume").alias("total_volume"), F.col("n").alias("market_cap_rank"),
    )
    bars = month_of(frames.bars(spark, folder))
    pages = bars.groupBy("symbol", "month").agg(F.to_json(F.collect_list(record)).alias("page"))
    return P.market_records(pages, "page").select("coin_id", "symbol", "name", "price_usd", "volume_24h", "rank")


@query("json_nested_scalars", """
SELECT event_id, value * 1000 AS total_market_cap, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS total_volume_24h,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS btc_dominance, 0.0::DOUBLE AS eth_dominance, user_id AS active_coins
FROM events""")
def json_nested_scalars(spark, folder):
    k = F.get_json_object("props", "$.k").cast("double")
    volume = F.when(F.col("event_type") != "error", F.struct(F.col("value").alias("usd")))
    payload = F.to_json(
        F.struct(
            F.struct(
                F.struct((F.col("value") * 1000).alias("usd")).alias("total_market_cap"),
                volume.alias("total_volume"),
                F.struct(k.alias("btc")).alias("market_cap_percentage"),
                F.col("user_id").alias("active_cryptocurrencies"),
            ).alias("data")
        )
    )
    events = star.table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return P.global_stats(events, "payload").drop("market_cap_change_24h")


@query("sentiment_index", """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 50 ELSE k END AS INT) AS value,
       CASE WHEN event_type = 'error' THEN 'Neutral' ELSE event_type END AS label,
       CASE WHEN event_type = 'error' THEN 0::BIGINT ELSE 2::BIGINT END AS n_history
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def sentiment_index(spark, folder):
    k = F.get_json_object("props", "$.k")
    entry = F.struct(k.alias("value"), F.col("event_type").alias("value_classification"), F.col("ts").cast("string").alias("timestamp"))
    data = F.when(F.col("event_type") != "error", F.array(entry, entry))
    events = star.table(spark, folder, "events").select("event_id", F.to_json(F.struct(data.alias("data"))).alias("payload"))
    parsed = P.sentiment_index(events, "payload")
    return parsed.select("event_id", "value", "label", F.size("history").cast("bigint").alias("n_history"))


@query("json_parallel_arrays", using("bars", body="""
SELECT symbol, date, close AS price, CASE WHEN symbol LIKE '%USDT' THEN volume END AS volume FROM bars"""))
def json_parallel_arrays(spark, folder):
    """Bridge-quoted symbols get one volume too many, so their volumes must be ignored."""
    ms = F.unix_millis(F.col("date").cast("timestamp")).cast("double")
    extra = F.when(F.col("symbol").endswith("USDT"), F.array().cast("array<array<double>>")).otherwise(
        F.array(F.array(F.lit(0.0), F.lit(0.0)))
    )
    pages = (
        month_of(frames.bars(spark, folder))
        .groupBy("symbol", "month")
        .agg(F.collect_list(F.struct(F.array(ms, F.col("close")).alias("p"), F.array(ms, F.col("volume")).alias("v"))).alias("r"))
        .select(
            "symbol",
            F.to_json(F.struct(F.col("r.p").alias("prices"), F.concat(F.col("r.v"), extra).alias("total_volumes"))).alias("page"),
        )
    )
    return P.parallel_history(pages, "page").select("symbol", F.col("date").cast("date").alias("date"), "price", "volume")


@query("json_positional_rows", using("bars", body="SELECT symbol, date, close AS price, volume FROM bars WHERE day(date) <> 3"))
def json_positional_rows(spark, folder):
    """Rows of the third day of a month are cut short and must be left out."""
    ms = F.unix_millis(F.col("date").cast("timestamp"))
    row = F.array(ms.cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    short = F.when(F.col("n") == 3, F.slice(row, 1, 5)).otherwise(row)
    bars = month_of(frames.bars(spark, folder))
    pages = bars.groupBy("symbol", "month").agg(F.to_json(F.collect_list(short)).alias("page"))
    return P.positional_candles(pages, "page").select("symbol", F.col("date").cast("date").alias("date"), "price", "volume")


@query("news_articles", """
SELECT text AS title, '#' AS url, source, lang AS currencies,
       CASE WHEN doc_id % 7 > doc_id % 5 THEN 'bullish' WHEN doc_id % 5 > doc_id % 7 THEN 'bearish' ELSE 'neutral' END AS sentiment,
       doc_id % 4 > 2 AS is_hot FROM documents""")
def news_articles(spark, folder):
    item = F.struct(
        F.col("text").alias("title"),
        F.struct(F.col("source").alias("title")).alias("source"),
        F.array(F.struct(F.col("lang").alias("code"))).alias("currencies"),
        F.struct((F.col("doc_id") % 7).alias("positive"), (F.col("doc_id") % 5).alias("negative"),
                 (F.col("doc_id") % 4).alias("important")).alias("votes"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("results"))).alias("payload")
    articles = P.news_articles(star.table(spark, folder, "documents").select(payload), "payload")
    return articles.select("title", "url", "source", F.array_join("currencies", ",").alias("currencies"), "sentiment", "is_hot")
