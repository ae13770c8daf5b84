"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.functions import calendar as D
from tickerloom.functions import display as Y
from tickerloom.functions import text as X
from tickerloom.operators import selection as S
from tickerloom.sources import star

NOW = "2024-02-01 00:00:00"
CATEGORIES = ["Widget", "Ring", "Bolt", "Small Gear"]
AMOUNT = "sqrt(o_totalprice) * power(10, o_orderkey % 12 - 3)"


def amounts(spark, folder, spread=12, down=3):
    scale = F.pow(F.lit(10.0), (F.col("o_orderkey") % spread - down).cast("double"))
    return star.table(spark, folder, "orders").select("o_orderkey", (F.sqrt("o_totalprice") * scale).alias("amount"))


@query("clean_ticker", using("bars", body="SELECT DISTINCT symbol, regexp_replace(symbol, 'USDT', '') AS ticker FROM bars"))
def clean_ticker(spark, folder):
    spelled = F.concat(F.lit(" "), F.regexp_replace(F.lower("symbol"), "usdt", "-usdt"))
    listed = frames.bars(spark, folder).select("symbol", spelled.alias("name")).distinct()
    return listed.select("symbol", X.clean_ticker(F.col("name")).alias("ticker"))


@query("strip_html", """
SELECT page_id, length(t) AS n_chars, md5(t) AS digest, substring(t, 1, 800) AS description
FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)""")
def strip_html(spark, folder):
    text = X.strip_html(F.col("html"))
    return star.table(spark, folder, "pages").select(
        "page_id",
        F.length(text).cast("bigint").alias("n_chars"),
        F.md5(text.cast("binary")).alias("digest"),
        X.description(F.col("html")).alias("description"),
    )


@query("humanize_age", f"""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'yesterday ' WHEN d < 60 THEN concat(d, 's ago')
  WHEN d < 3600 THEN concat(d // 60, 'm ago') WHEN d < 86400 THEN concat(d // 3600, 'h ago') ELSE concat(d // 86400, 'd ago') END AS age
FROM (SELECT event_id, CAST(epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts)) AS BIGINT) AS d FROM events)""")
def humanize_age(spark, folder):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    spelled = F.when(F.col("event_id") % 11 == 0, F.lit("")).when(F.col("event_id") % 13 == 0, F.lit("yesterday evening")).otherwise(iso)
    events = star.table(spark, folder, "events").select("event_id", spelled.alias("published_at"))
    return events.select("event_id", X.humanize_age(F.col("published_at"), F.lit(NOW)).alias("age"))


@query("abbrev_money", f"""
SELECT o_orderkey, CASE WHEN a >= 1e12 THEN printf('$%.2fT', a / 1e12) WHEN a >= 1e9 THEN printf('$%.2fB', a / 1e9)
  WHEN a >= 1e6 THEN printf('$%.2fM', a / 1e6) ELSE format('${{:,}}', CAST(round(a) AS BIGINT)) END AS money
FROM (SELECT o_orderkey, {AMOUNT} AS a FROM orders)""")
def abbrev_money(spark, folder):
    return amounts(spark, folder).select("o_orderkey", Y.abbrev_money(F.col("amount")).alias("money"))


PRICE = AMOUNT.replace("% 12 - 3", "% 7 - 4")


@query("tiered_price_text", f"""
SELECT o_orderkey, CASE WHEN a >= 1000 THEN concat('$', format('{{:,}}', CAST(floor(round(a * 100) / 100) AS BIGINT)),
    '.', lpad(CAST(CAST(round(a * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'))
  WHEN a >= 1 THEN printf('$%.4f', a) ELSE printf('$%.6f', a) END AS price
FROM (SELECT o_orderkey, {PRICE} AS a FROM orders)""")
def tiered_price_text(spark, folder):
    return amounts(spark, folder, 7, 4).select("o_orderkey", Y.tiered_price_text(F.col("amount")).alias("price"))


@query("signed_pct_text", using("analyzed", body="""
SELECT symbol, date, concat(CASE WHEN c < 0 THEN '-' ELSE '+' END, printf('%.2f', abs(c)), '%') AS change
FROM (SELECT symbol, date, CASE WHEN prev_close_usd IS NULL THEN 0.0 ELSE 100 * daily_return END AS c FROM analyzed)"""))
def signed_pct_text(spark, folder):
    change = F.when(F.col("prev_close_usd").isNotNull(), 100 * F.col("daily_return"))
    return frames.scored(spark, folder).select("symbol", "date", Y.signed_pct_text(change).alias("change"))


@query("sentiment_band", """
SELECT event_id, CASE WHEN k <= 20 THEN 'Extreme Fear' WHEN k <= 40 THEN 'Fear' WHEN k <= 60 THEN 'Neutral'
  WHEN k <= 80 THEN 'Greed' ELSE 'Extreme Greed' END AS band
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def sentiment_band(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    return star.table(spark, folder, "events").select("event_id", Y.sentiment_band(k).alias("band"))


@query("vote_sentiment", """
SELECT doc_id, CASE WHEN doc_id % 7 > doc_id % 5 THEN 'bullish' WHEN doc_id % 5 > doc_id % 7 THEN 'bearish' ELSE 'neutral' END AS sentiment
FROM documents""")
def vote_sentiment(spark, folder):
    votes = Y.vote_sentiment(F.col("doc_id") % 7, F.col("doc_id") % 5)
    return star.table(spark, folder, "documents").select("doc_id", votes.alias("sentiment"))


@query("hot_flag", "SELECT doc_id, doc_id % 4 > 2 AS is_hot FROM documents")
def hot_flag(spark, folder):
    return star.table(spark, folder, "documents").select("doc_id", Y.hot_flag(F.col("doc_id") % 4).alias("is_hot"))


@query("array_field", "SELECT doc_id, concat(lang, ',', source) AS codes FROM documents")
def array_field(spark, folder):
    items = F.array(F.struct(F.col("lang").alias("code")), F.struct(F.col("source").alias("code")))
    codes = F.array_join(Y.array_field(items, "code"), ",")
    return star.table(spark, folder, "documents").select("doc_id", codes.alias("codes"))


@query("staleness_days", using("bars", body=f"""
SELECT symbol, last_date, date_diff('day', last_date, DATE '2001-11-15') AS days_stale,
       date_diff('day', last_date, DATE '2001-11-15') > 3 AS is_stale
FROM (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol)"""))
def staleness_days(spark, folder):
    last = frames.bars(spark, folder).groupBy("symbol").agg(F.max("date").alias("last_date"))
    days = D.whole_days_since(F.col("last_date"), F.lit("2001-11-15 12:00:00"))
    return last.withColumn("days_stale", days).withColumn("is_stale", F.col("days_stale") > 3)


@query("parse_iso_date", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS DATE) END AS day FROM events""")
def parse_iso_date(spark, folder):
    spelled = F.when(F.col("event_id") % 10 == 0, F.lit("soon")).otherwise(F.col("ts").cast("date").cast("string"))
    return star.table(spark, folder, "events").select("event_id", D.parse_iso_date(spelled).alias("day"))


@query("exp_decay", using("bars", body="""
SELECT symbol, date, round(exp(-((SELECT max(date) FROM bars) - date) / 180.0), 6) AS weight FROM bars"""))
def exp_decay(spark, folder):
    bars = frames.bars(spark, folder)
    step = F.date_diff(S.max_date(bars).scalar(), F.col("date"))
    return rounded(bars.select("symbol", "date", Y.exp_decay(step).alias("weight")))


@query("signal_text", using("labelled", body="""
SELECT symbol, next_date AS date, CASE prediction WHEN 'UP' THEN 'BUY' WHEN 'DOWN' THEN 'SELL' ELSE 'HOLD' END AS signal FROM labelled"""))
def signal_text(spark, folder):
    rows = frames.predicted(spark, folder)
    return rows.select("symbol", F.col("next_date").alias("date"), Y.signal_text(F.col("prediction")).alias("signal"))


@query("days_until", "SELECT o_orderkey, DATE '2028-04-15' - CAST(o_orderdate AS DATE) AS days_left FROM orders")
def days_until(spark, folder):
    orders = star.table(spark, folder, "orders")
    return orders.select("o_orderkey", D.days_until("2028-04-15", F.col("o_orderdate")).alias("days_left"))


@query("keyword_filter", """
SELECT doc_id, source FROM documents WHERE contains(lower(text), 'der') AND doc_id % 7 > doc_id % 5""")
def keyword_filter(spark, folder):
    bullish = Y.vote_sentiment(F.col("doc_id") % 7, F.col("doc_id") % 5) == "bullish"
    return X.keyword_filter(star.table(spark, folder, "documents"), "text", "DER", bullish).select("doc_id", "source")


@query("containment_lookup", """
SELECT p_partkey, CASE WHEN contains(n, 'widget') OR contains('widget', n) THEN 'Widget'
  WHEN contains(n, 'ring') OR contains('ring', n) THEN 'Ring' WHEN contains(n, 'bolt') OR contains('bolt', n) THEN 'Bolt'
  WHEN contains(n, 'small gear') OR contains('small gear', n) THEN 'Small Gear' ELSE 'Other' END AS category
FROM (SELECT p_partkey, lower(p_name) AS n FROM part)""")
def containment_lookup(spark, folder):
    category = X.containment_lookup(F.col("p_name"), CATEGORIES, "Other")
    return star.table(spark, folder, "part").select("p_partkey", category.alias("category"))


@query("rename_round_percent", using("labelled", body="""
SELECT symbol, next_date AS date, round(score_up * 100, 1) AS prob_up_pct, round(score_down * 100, 1) AS prob_down_pct,
       round(score_neutral * 100, 1) AS prob_neutral_pct FROM labelled"""))
def rename_round_percent(spark, folder):
    rows = frames.predicted(spark, folder).select("symbol", F.col("next_date").alias("date"), "score_up", "score_down", "score_neutral")
    return Y.percent_columns(rows, {f"score_{s}": f"prob_{s}_pct" for s in ("up", "down", "neutral")})


@query("fill_frame", using("analyzed", body="""
SELECT symbol, date, round(coalesce(prev_close_usd, 0), 6) AS prev_close_usd,
       round(coalesce(close_usd_30d_ago, 0), 6) AS close_usd_30d_ago FROM analyzed"""))
def fill_frame(spark, folder):
    wide = frames.scored(spark, folder).select("symbol", "date", "prev_close_usd", "close_usd_30d_ago")
    return rounded(wide.na.fill(0))


@query("pinball_loss", using("returns", "thresholds", body="""
SELECT x.symbol, round(avg(greatest(0.3 * (r - p30), 0.7 * (p30 - r))), 6) AS loss_p30,
       round(avg(greatest(0.7 * (r - p70), 0.3 * (p70 - r))), 6) AS loss_p70
FROM returns x JOIN thresholds t ON t.symbol = x.symbol GROUP BY x.symbol"""))
def pinball_loss(spark, folder):
    from tickerloom.learning.quantile import pinball
    from tickerloom.operators.labels import with_thresholds

    rows = with_thresholds(frames.returns(spark, folder))
    return rounded(rows.groupBy("symbol").agg(
        pinball(F.col("r"), F.col("p30"), 0.3).alias("loss_p30"), pinball(F.col("r"), F.col("p70"), 0.7).alias("loss_p70")
    ))
