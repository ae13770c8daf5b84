"""Correlation table, its restrictions and its clusters."""

from __future__ import annotations

from catalog import frames
from catalog.registry import query, rounded
from catalog.sql import using
from tickerloom.operators import contagion as C
from tickerloom.operators import ranking as K
from tickerloom.operators import selection as S
from tickerloom.sources import tables as T

SYMBOLS = ["BTCUSDT"] + [f"B{n}USDT" for n in range(2, 21)] + [f"B{n}BTC" for n in range(21, 26)]

DENSE = """
, recent AS MATERIALIZED (
  SELECT symbol, date, daily_return FROM scored WHERE date >= (SELECT max(date) FROM scored) - 30
), dense AS MATERIALIZED (
  SELECT s.symbol, d.date, coalesce(r.daily_return, 0.0) AS x, r.daily_return IS NOT NULL AS seen
  FROM (SELECT DISTINCT symbol FROM recent) s CROSS JOIN (SELECT DISTINCT date FROM recent) d
  LEFT JOIN recent r ON r.symbol = s.symbol AND r.date = d.date
), pairs AS MATERIALIZED (
  SELECT a.symbol AS symbol_a, b.symbol AS symbol_b,
         CASE WHEN max(a.x) > min(a.x) AND max(b.x) > min(b.x) THEN corr(a.x, b.x) END AS corr,
         count(*) AS n_days, count(*) FILTER (WHERE a.seen AND b.seen) AS n_common
  FROM dense a JOIN dense b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY a.symbol, b.symbol
)"""


def on_pairs(body: str, recursive: bool = False) -> str:
    """Append the correlation tables to the shared ones."""
    text = using("scored", body="\x00")
    text = text.replace("\n\x00", DENSE + "\n" + body)
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text


@query("pearson_matrix", on_pairs("SELECT symbol_a, symbol_b, round(corr, 6) AS corr, n_days FROM pairs"))
def pearson_matrix(spark, folder):
    matrix = C.contagion_matrix(frames.scored(spark, folder))
    return rounded(matrix.select("symbol_a", "symbol_b", "corr", "n_days"))


@query("pairwise_self_join", on_pairs("SELECT symbol_a, symbol_b, n_common FROM pairs"))
def pairwise_self_join(spark, folder):
    return C.contagion_matrix(frames.scored(spark, folder)).select("symbol_a", "symbol_b", "n_common")


@query("submatrix", on_pairs("""
SELECT symbol_a, symbol_b, round(corr, 6) AS corr FROM pairs, (
  SELECT list(symbol) AS chosen FROM (
    SELECT symbol FROM scored WHERE date = (SELECT max(date) FROM scored) AND symbol IN (
      SELECT symbol FROM scored GROUP BY symbol HAVING count(date) >= 0.6 * (SELECT count(DISTINCT date) FROM scored))
    ORDER BY avg_volume_30d DESC, symbol LIMIT 30))
WHERE list_contains(chosen, symbol_a) AND list_contains(chosen, symbol_b)"""))
def submatrix(spark, folder):
    scored = frames.scored(spark, folder)
    chosen = K.top_by_volume(scored, min_coverage=0.6).select("symbol")
    return rounded(C.submatrix(scored, chosen).select("symbol_a", "symbol_b", "corr"))


@query("pivot_returns", using("scored", body=f"""
SELECT date, {', '.join(f"coalesce(round(avg(daily_return) FILTER (WHERE symbol = '{s}'), 6), 0.0) AS {s}" for s in SYMBOLS)}
FROM scored WHERE date >= (SELECT max(date) FROM scored) - 30 GROUP BY date"""))
def pivot_returns(spark, folder):
    recent = S.trailing_days(frames.scored(spark, folder).select("symbol", "date", "daily_return"))
    return rounded(C.pivot_returns(recent, SYMBOLS))


@query("export_matrix_csv", on_pairs(f"""
SELECT symbol, {', '.join(f"max(corr) FILTER (WHERE other = '{s}') AS {s}" for s in SYMBOLS)} FROM (
  SELECT symbol_a AS symbol, symbol_b AS other, round(corr, 6) AS corr FROM pairs
  UNION ALL SELECT symbol_b, symbol_a, round(corr, 6) FROM pairs WHERE symbol_a <> symbol_b) GROUP BY symbol"""))
def export_matrix_csv(spark, folder):
    chosen = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    pairs = rounded(C.submatrix(frames.scored(spark, folder), chosen))
    wide = C.wide_matrix(pairs, SYMBOLS).withColumnRenamed("symbol_a", "symbol")
    path = T.fresh_path(spark, "contagion_matrix_csv")
    T.write_matrix_csv(wide, path)
    return T.read_matrix_csv(spark, path, "symbol", SYMBOLS)


@query("contagion_clusters", on_pairs("""
, links AS MATERIALIZED (
  SELECT symbol_a AS u, symbol_b AS v FROM pairs WHERE corr >= 0.35 AND symbol_a <> symbol_b
  UNION ALL SELECT symbol_b, symbol_a FROM pairs WHERE corr >= 0.35 AND symbol_a <> symbol_b
), reach(symbol, member) AS (
  SELECT DISTINCT symbol, symbol FROM recent UNION SELECT r.symbol, l.v FROM reach r JOIN links l ON l.u = r.member)
SELECT symbol, min(member) AS cluster FROM reach GROUP BY symbol""", recursive=True))
def contagion_clusters(spark, folder):
    return C.contagion_clusters(frames.scored(spark, folder), threshold=0.35)
