"""Common table expressions shared by the SQL statements."""

from __future__ import annotations

BARS = """
SELECT CASE WHEN n = 1 THEN 'BTCUSDT'
            WHEN n <= 20 THEN concat('B', CAST(n AS VARCHAR), 'USDT')
            ELSE concat('B', CAST(n AS VARCHAR), 'BTC') END AS symbol,
       date,
       min_by(px, seq) AS open, max(px) AS high, min(px) AS low, max_by(px, seq) AS close,
       sum(qty) AS volume, round(sum(amt), 2) AS quote_asset_volume, count(*) AS number_of_trades
FROM (
  SELECT CAST(substr(p_brand, 7) AS INT) AS n, CAST(l_shipdate AS DATE) AS date,
         sqrt(sqrt(l_extendedprice / l_quantity)) AS px, l_quantity AS qty, l_extendedprice AS amt,
         row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY n, date"""

TWIN_BARS = """
SELECT * FROM bars
UNION ALL
SELECT regexp_replace(symbol, 'USDT$', 'BTC') AS symbol, date, open, high, low, close, volume,
       quote_asset_volume, number_of_trades
FROM bars WHERE symbol IN ('B2USDT', 'B3USDT', 'B4USDT')"""


def _usd(src: str) -> str:
    return f"""
SELECT date, symbol, close, volume, close AS close_usd, volume AS volume_usd FROM {src} WHERE symbol LIKE '%USDT'
UNION ALL
SELECT b.date, b.symbol, b.close, b.volume, b.close * x.close AS close_usd, b.volume * x.close AS volume_usd
FROM {src} b JOIN (SELECT date, close FROM {src} WHERE symbol = 'BTCUSDT') x ON b.date = x.date
WHERE b.symbol LIKE '%BTC'
  AND NOT EXISTS (SELECT 1 FROM {src} u WHERE u.symbol = regexp_replace(b.symbol, 'BTC$', 'USDT'))"""


ANALYZED = """
SELECT date, symbol, close, volume, close_usd, volume_usd, prev_close_usd, daily_return,
       coalesce(stddev_samp(daily_return) OVER (PARTITION BY symbol ORDER BY date
         ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * sqrt(365), 0.0) AS volatility_7d,
       coalesce(stddev_samp(daily_return) OVER (PARTITION BY symbol ORDER BY date
         ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * sqrt(365), 0.0) AS volatility_30d,
       close_usd_30d_ago,
       CASE WHEN close_usd_30d_ago IS NULL OR close_usd_30d_ago = 0 THEN 0.0
            ELSE (close_usd - close_usd_30d_ago) / close_usd_30d_ago END AS return_30d,
       avg(volume_usd) OVER (PARTITION BY symbol ORDER BY date
         ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS avg_volume_30d
FROM (
  SELECT *, CASE WHEN prev_close_usd IS NULL OR prev_close_usd = 0 THEN 0.0
                 ELSE (close_usd - prev_close_usd) / prev_close_usd END AS daily_return
  FROM (SELECT *, lag(close_usd, 1) OVER w AS prev_close_usd, lag(close_usd, 30) OVER w AS close_usd_30d_ago
        FROM usd_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)))"""

SCORED = """
SELECT *, return_30d / safe_volatility AS safety_score
FROM (SELECT *, CASE WHEN volatility_30d <= 0 THEN 1e-9 ELSE volatility_30d END AS safe_volatility FROM analyzed)"""

MARKET = "SELECT date, daily_return AS btc_return FROM analyzed WHERE symbol = 'BTCUSDT'"

# price, clipped return and running row number of every series
RETURNS = """
SELECT symbol, date, close_usd AS p, volume_usd AS v, btc_return, i,
       CASE WHEN prev IS NULL THEN 0.0
            ELSE greatest(-0.5, least(5.0, (p0 - prev) / (abs(prev) + 1e-9))) END AS r
FROM (SELECT u.symbol, u.date, u.close_usd, u.close_usd AS p0, u.volume_usd, coalesce(m.btc_return, 0.0) AS btc_return,
             row_number() OVER w - 1 AS i, lag(u.close_usd) OVER w AS prev
      FROM usd_bars u LEFT JOIN market m ON u.date = m.date
      WINDOW w AS (PARTITION BY u.symbol ORDER BY u.date))"""

EMA = """
SELECT symbol, i, r, r AS ema12, r AS ema26 FROM returns WHERE i = 0
UNION ALL
SELECT x.symbol, x.i, x.r, (2.0 / 13) * x.r + (11.0 / 13) * e.ema12, (2.0 / 27) * x.r + (25.0 / 27) * e.ema26
FROM ema e JOIN returns x ON x.symbol = e.symbol AND x.i = e.i + 1"""

THRESHOLDS = """
SELECT symbol, coalesce(quantile_cont(r, 0.3) FILTER (WHERE r <> 0), -0.01) AS p30,
       coalesce(quantile_cont(r, 0.7) FILTER (WHERE r <> 0), 0.01) AS p70,
       count(*) AS n_rows, stddev_pop(p) / (avg(abs(p)) + 1e-9) AS cv
FROM returns GROUP BY symbol"""

LABELLED = """
SELECT x.symbol, x.date, x.i, x.r, x.p, x.next_return, x.next_date, x.i - 30 AS k,
       (count(*) OVER (PARTITION BY x.symbol)) AS n,
       CASE WHEN x.next_return > t.p70 THEN 'UP' WHEN x.next_return < t.p30 THEN 'DOWN' ELSE 'NEUTRAL' END AS label,
       CASE WHEN x.r > t.p70 THEN 'UP' WHEN x.r < t.p30 THEN 'DOWN' ELSE 'NEUTRAL' END AS prediction,
       greatest(x.r - t.p70, 0.0) AS score_up, greatest(t.p30 - x.r, 0.0) AS score_down,
       least(greatest(t.p70 - x.r, 0.0), greatest(x.r - t.p30, 0.0)) AS score_neutral
FROM (SELECT *, lead(r) OVER w AS next_return, lead(date) OVER w AS next_date
      FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date)) x
JOIN thresholds t ON t.symbol = x.symbol
WHERE x.i >= 30 AND x.next_return IS NOT NULL AND t.n_rows >= 180 AND t.cv >= 0.10"""

FOLDED = """
SELECT l.*, f.fold, CASE WHEN k < n - (3 - f.fold) * (n // 4) THEN 'train' ELSE 'test' END AS part
FROM labelled l, (VALUES (0), (1), (2)) f(fold)
WHERE k < n - (2 - f.fold) * (n // 4)"""

SNAPSHOT = """
SELECT symbol, date, close_usd AS price_usd, close_usd * volume_usd AS market_cap, volume_usd AS volume_24h,
       100 * daily_return AS change_24h
FROM analyzed QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"""

POSITION_LOG = """
SELECT 4 * o_orderkey AS seq, 'add' AS op, o_orderkey AS id, concat('B', CAST(o_custkey % 25 AS VARCHAR), 'USDT') AS coin,
       CAST(1 + o_orderkey % 10 AS DOUBLE) AS qty, o_totalprice / 100 AS buy_price, o_orderdate AS added_at FROM orders
UNION ALL
SELECT 4 * o_orderkey + 1, 'update', o_orderkey, NULL, 2.0 * (1 + o_orderkey % 10), o_totalprice / 100, NULL
FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT 4 * o_orderkey + 2, 'delete', o_orderkey, NULL, NULL, NULL, NULL FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL
SELECT 4 * (max(o_orderkey) // 10) + 3, 'clear', NULL, NULL, NULL, NULL, NULL FROM orders"""

# state kept by replaying the statements one id at a time
POSITIONS = """
SELECT a.id, a.coin, coalesce(u.qty, a.qty) AS qty, coalesce(u.buy_price, a.buy_price) AS buy_price, a.added_at
FROM position_log a
LEFT JOIN (SELECT id, qty, buy_price FROM position_log WHERE op = 'update'
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) u ON u.id = a.id
WHERE a.op = 'add'
  AND NOT EXISTS (SELECT 1 FROM position_log d WHERE d.op = 'delete' AND d.id = a.id AND d.seq > a.seq)
  AND NOT EXISTS (SELECT 1 FROM position_log c WHERE c.op = 'clear' AND c.seq > a.seq)"""

_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "bars": (BARS, ()),
    "twin_bars": (TWIN_BARS, ("bars",)),
    "usd_bars": (_usd("bars"), ("bars",)),
    "twin_usd_bars": (_usd("twin_bars"), ("twin_bars",)),
    "analyzed": (ANALYZED, ("usd_bars",)),
    "scored": (SCORED, ("analyzed",)),
    "market": (MARKET, ("analyzed",)),
    "returns": (RETURNS, ("usd_bars", "market")),
    "ema": (EMA, ("returns",)),
    "thresholds": (THRESHOLDS, ("returns",)),
    "labelled": (LABELLED, ("returns", "thresholds")),
    "folded": (FOLDED, ("labelled",)),
    "snapshot": (SNAPSHOT, ("analyzed",)),
    "position_log": (POSITION_LOG, ()),
    "positions": (POSITIONS, ("position_log",)),
}


def using(*names: str, body: str) -> str:
    """``body`` preceded by the named tables and everything they are built from."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in _TABLES[name][1]:
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    recursive = "RECURSIVE " if "ema" in ordered else ""
    ctes = ",\n".join(f"{n} AS {'' if n == 'ema' else 'MATERIALIZED '}({_TABLES[n][0]})" for n in ordered)
    return f"WITH {recursive}{ctes}\n{body}"
