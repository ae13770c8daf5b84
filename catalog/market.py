"""Listings, portfolio and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.functions.text import chunk_text as slices
from tickerloom.operators import dialogue as G
from tickerloom.operators import portfolio as P
from tickerloom.operators import snapshot as M
from tickerloom.sources import star
from tickerloom.sources import tables as T
from tickerloom.workspace import fresh_path


def listing(spark, folder):
    return M.market_snapshot(frames.scored(spark, folder))


SIZE = "ORDER BY market_cap DESC, symbol"


@query("market_topn", using("snapshot", body=f"""
SELECT symbol, date, round(price_usd, 6) AS price_usd, round(market_cap, 6) AS market_cap, round(volume_24h, 6) AS volume_24h,
       round(change_24h, 6) AS change_24h, CAST(row_number() OVER ({SIZE}) AS INT) AS rank
FROM (SELECT * FROM snapshot {SIZE} LIMIT 20)"""))
def market_topn(spark, folder):
    return rounded(M.market_topn(listing(spark, folder), 20))


@query("latest_by_ticker", using("snapshot", body="""
SELECT upper(substr(symbol, 1, 2)) AS ticker, symbol, round(price_usd, 6) AS price_usd FROM snapshot
QUALIFY row_number() OVER (PARTITION BY substr(symbol, 1, 2) ORDER BY market_cap, symbol DESC) = 1"""))
def latest_by_ticker(spark, folder):
    rank = [-F.col("market_cap"), F.col("symbol")]
    kept = M.latest_by_ticker(listing(spark, folder), F.lower(F.substring("symbol", 1, 2)), rank)
    return rounded(kept.select("ticker", "symbol", "price_usd"))


@query("top_bottom_movers", using("snapshot", body="""
SELECT 'gainer' AS side, CAST(row_number() OVER (ORDER BY change_24h DESC, symbol) AS INT) AS place, symbol,
       round(change_24h, 6) AS change_24h FROM (SELECT * FROM snapshot ORDER BY change_24h DESC, symbol LIMIT 5)
UNION ALL
SELECT 'loser', CAST(row_number() OVER (ORDER BY change_24h, symbol DESC) AS INT), symbol, round(change_24h, 6)
FROM (SELECT * FROM snapshot ORDER BY change_24h, symbol DESC LIMIT 5)"""))
def top_bottom_movers(spark, folder):
    return rounded(M.top_bottom_movers(listing(spark, folder)).select("side", "place", "symbol", "change_24h"))


@query("heatmap_table", using("snapshot", body=f"""
SELECT concat(symbol, '<br>', CASE WHEN change_24h < 0 THEN '-' ELSE '+' END, printf('%.2f', abs(change_24h)), '%') AS label,
       round(market_cap, 6) AS market_cap, round(change_24h, 6) AS change_24h FROM snapshot {SIZE} LIMIT 30"""))
def heatmap_table(spark, folder):
    return rounded(M.heatmap_table(listing(spark, folder)))


@query("limit_per_source", """
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 8
ORDER BY source, doc_id DESC LIMIT 50""")
def limit_per_source(spark, folder):
    articles = star.table(spark, folder, "documents").select("source", "doc_id")
    return M.limit_per_source(articles, [F.desc("doc_id")])


CONTEXT_SQL = f"""
SELECT concat('[LIVE MARKET CONTEXT — 2024-02-01 00:00 UTC]', chr(10), 'Fear & Greed Index: ', (
    SELECT concat(CAST(max_by(CAST(json_extract_string(props, '$.k') AS INT), event_id) AS VARCHAR), '/100 — ', max_by(event_type, event_id))
    FROM events), chr(10),
  'Global Market Cap: $', format('{{:,}}', CAST(round(sum(market_cap)) AS BIGINT)), ' (', CASE WHEN sum(market_cap * change_24h) < 0 THEN '-' ELSE '+' END,
  printf('%.2f', abs(sum(market_cap * change_24h) / sum(market_cap))), '% 24h)', chr(10),
  '24h Volume: $', format('{{:,}}', CAST(round(sum(volume_24h)) AS BIGINT)), chr(10),
  'BTC Dominance: ', printf('%.1f', 100 * sum(market_cap) FILTER (WHERE symbol LIKE 'BTC%') / sum(market_cap)), '%', chr(10), chr(10),
  'Live Coin Prices:', chr(10),
  (SELECT string_agg(concat('  ', symbol, ' (', symbol, ') = $', printf(CASE WHEN price_usd >= 1 THEN '%.4f' ELSE '%.6f' END, price_usd), ' (',
     CASE WHEN change_24h < 0 THEN '-' ELSE '+' END, printf('%.2f', abs(change_24h)), '% 24h)'), chr(10) {SIZE})
   FROM (SELECT * FROM snapshot {SIZE} LIMIT 25))) AS context FROM snapshot"""


@query("context_block", using("snapshot", body=CONTEXT_SQL))
def context_block(spark, folder):
    events = star.table(spark, folder, "events")
    index = events.agg(
        F.max_by(F.get_json_object("props", "$.k").cast("int"), "event_id").alias("value"),
        F.max_by("event_type", "event_id").alias("label"),
    )
    return M.context_block(listing(spark, folder), index, "2024-02-01 00:00 UTC")


@query("analyst_verdict", using("scored", body="""
SELECT symbol, CASE WHEN safety_score >= 0.1 AND return_30d > 0 THEN 'Bullish'
  WHEN return_30d <= 0 AND (SELECT max_by(CAST(json_extract_string(props, '$.k') AS INT), event_id) FROM events) <= 40 AND volatility_30d < 4
    THEN 'Contrarian Buy'
  WHEN safety_score < 0 AND return_30d < 0 THEN 'Bearish' ELSE 'Watch' END AS verdict
FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"""))
def analyst_verdict(spark, folder):
    mood = star.table(spark, folder, "events").agg(F.max_by(F.get_json_object("props", "$.k").cast("int"), "event_id")).scalar()
    newest = frames.scored(spark, folder).groupBy("symbol").agg(
        F.max_by(F.struct("safety_score", "return_30d", "volatility_30d"), "date").alias("n")
    ).withColumn("mood", mood)
    verdict = M.analyst_verdict(F.col("n.safety_score"), F.col("n.return_30d"), F.col("n.volatility_30d"), F.col("mood"))
    return newest.select("symbol", verdict.alias("verdict"))


def position_log(spark, folder):
    """Adds for every order, updates for filled ones, deletes for those of low priority, one clear after a tenth of the keys."""
    orders = star.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    nothing = {"coin": "string", "qty": "double", "buy_price": "double", "added_at": "timestamp"}

    def event(rows, op, offset, **values):
        filled = {n: values.get(n, F.lit(None)).cast(t).alias(n) for n, t in nothing.items()}
        return rows.select((4 * key + offset).alias("seq"), F.lit(op).alias("op"), key.alias("id"), *filled.values())

    qty = (1 + key % 10).cast("double")
    price = F.col("o_totalprice") / 100
    coin = F.concat(F.lit("B"), (F.col("o_custkey") % 25).cast("string"), F.lit("USDT"))
    added = event(orders, "add", 0, coin=coin, qty=qty, buy_price=price, added_at=F.col("o_orderdate"))
    updated = event(orders.filter(F.col("o_orderstatus") == "F"), "update", 1, qty=qty * 2, buy_price=price)
    deleted = event(orders.filter(F.col("o_orderpriority") == "5-LOW"), "delete", 2)
    top = orders.agg(F.expr("max(o_orderkey) div 10").alias("o_orderkey"))
    cleared = event(top, "clear", 3).withColumn("id", F.lit(None).cast("bigint"))
    return added.unionByName(updated).unionByName(deleted).unionByName(cleared)


def positions(spark, folder):
    return P.positions_current(position_log(spark, folder))


@query("positions_current", using("positions", body="""
SELECT id, coin, qty, round(buy_price, 6) AS buy_price, CAST(added_at AS DATE) AS added_on FROM positions ORDER BY id"""))
def positions_current(spark, folder):
    current = positions(spark, folder).withColumn("added_on", F.col("added_at").cast("date")).drop("added_at")
    return rounded(current).orderBy("id")


@query("position_count", using("positions", body="SELECT count(*) AS position_count FROM positions"))
def position_count(spark, folder):
    return P.position_count(position_log(spark, folder))


MARKED = """
SELECT p.id, p.coin, p.qty * p.buy_price AS cost, p.qty * s.price_usd AS value, (s.price_usd - p.buy_price) * p.qty AS pnl,
       100 * (s.price_usd - p.buy_price) / nullif(p.buy_price, 0) AS pnl_pct
FROM positions p LEFT JOIN snapshot s ON s.symbol = p.coin"""


def marked(spark, folder):
    return P.mark_to_market(positions(spark, folder), listing(spark, folder))


@query("positions_price_join", using("positions", "snapshot", body="""
SELECT p.id, p.coin, round(s.price_usd, 6) AS price_usd FROM positions p LEFT JOIN snapshot s ON s.symbol = p.coin"""))
def positions_price_join(spark, folder):
    return rounded(P.join_prices(positions(spark, folder), listing(spark, folder)).select("id", "coin", "price_usd"))


@query("mark_to_market", using("positions", "snapshot", body=f"""
SELECT id, coin, round(cost, 4) AS cost, round(value, 4) AS value, round(pnl, 4) AS pnl, round(pnl_pct, 4) AS pnl_pct FROM ({MARKED})"""))
def mark_to_market(spark, folder):
    return rounded(marked(spark, folder).select("id", "coin", "cost", "value", "pnl", "pnl_pct"), 4)


@query("portfolio_totals", using("positions", "snapshot", body=f"""
SELECT round(sum(cost), 2) AS invested, round(sum(value), 2) AS current_value, round(sum(pnl), 2) AS pnl,
       count(*) AS n_positions, round(100 * sum(pnl) / sum(cost), 2) AS pnl_pct FROM ({MARKED})"""))
def portfolio_totals(spark, folder):
    return rounded(P.portfolio_totals(marked(spark, folder)), 2)


@query("allocation", using("positions", "snapshot", body=f"""
SELECT coin, round(sum(value), 4) AS value, round(sum(value) / (SELECT sum(value) FROM ({MARKED})), 6) AS share
FROM ({MARKED}) GROUP BY coin"""))
def allocation(spark, folder):
    shares = P.allocation(marked(spark, folder))
    return shares.select("coin", F.round("value", 4).alias("value"), F.round("share", 6).alias("share"))


@query("export_positions", using("positions", "snapshot", body=f"""
SELECT id, coin, round(cost, 4) AS cost, round(value, 4) AS value FROM ({MARKED})"""))
def export_positions(spark, folder):
    path = fresh_path(spark, "positions_csv")
    rows = rounded(marked(spark, folder).select("id", "coin", "cost", "value"), 4)
    T.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


@query("prompt_assembly", using("snapshot", body=f"""
, live AS MATERIALIZED ({CONTEXT_SQL})
SELECT conv_id, turn, CASE WHEN turn = last OR role = 'user' THEN 'user' ELSE 'model' END AS role,
       CASE WHEN turn = last THEN concat((SELECT context FROM live), chr(10), chr(10), 'User question: ', text) ELSE text END AS text
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"""))
def prompt_assembly(spark, folder):
    """The last turn of each conversation is led by the market context of the listing, one row read as a scalar."""
    context = context_block(spark, folder).select("context").scalar()
    return G.prompt_assembly(star.table(spark, folder, "conversations"), context)


@query("response_extract", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'I couldn''t generate a response. The model returned no candidates.'
  WHEN role = 'user' THEN 'The model returned an empty response (reason: SAFETY). Please try rephrasing your question.'
  ELSE concat(trim(text), ' .') END AS answer
FROM conversations""")
def response_extract(spark, folder):
    said = F.when(F.col("role") == "user", F.lit("  ")).otherwise(F.concat(F.lit(" "), F.trim("text")))
    tail = F.when(F.col("role") == "user", F.lit(" ")).otherwise(F.lit(" . "))
    parts = F.array(F.struct(said.alias("text")), F.struct(tail.alias("text")))
    one = F.struct(F.struct(parts.alias("parts")).alias("content"), F.lit("SAFETY").alias("finishReason"))
    candidates = F.when(F.col("turn") % 3 != 2, F.array(one))
    payload = F.to_json(F.struct(candidates.alias("candidates")))
    turns = star.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", G.response_extract(payload).alias("answer"))


@query("chunk_text", """
SELECT doc_id, CAST(i AS INT) AS chunk_no, substring(text, CAST(i * 50 + 1 AS BIGINT), 50) AS chunk
FROM (SELECT doc_id, text, unnest(range((length(text) + 49) // 50)) AS i FROM documents)""")
def chunk_text(spark, folder):
    return slices(star.table(spark, folder, "documents").select("doc_id", "text"), "text")
