"""One row per asset: newest state, rankings over it and the text block describing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.display import abbrev_money, fixed, signed_pct_text, tiered_price_text

# Fixed value: coins named in the context block.
CONTEXT_COINS = 25


def market_snapshot(scored: DataFrame) -> DataFrame:
    """Newest row of every symbol as a listing."""
    newest = scored.groupBy("symbol").agg(
        F.max("date").alias("date"),
        F.max_by(F.struct("close_usd", "volume_usd", "daily_return"), "date").alias("_n"),
    )
    price, volume = F.col("_n.close_usd"), F.col("_n.volume_usd")
    return newest.select(
        "symbol",
        "date",
        price.alias("price_usd"),
        (price * volume).alias("market_cap"),
        volume.alias("volume_24h"),
        (F.col("_n.daily_return") * 100).alias("change_24h"),
    )


def by_size() -> list[Column]:
    return [F.desc_nulls_last("market_cap"), F.asc("symbol")]


def market_topn(listing: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest by market cap with their rank. The rank window sees the ``n`` rows kept."""
    if n < 1:
        raise ValueError(f"n must be positive, not {n}")
    kept = listing.orderBy(*by_size()).limit(n)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*by_size())))


def latest_by_ticker(listing: DataFrame, ticker: Column, rank: list[Column]) -> DataFrame:
    """One row per upper-cased ticker; of several the one listed last stays."""
    kept = F.max_by(F.struct(*listing.columns), F.struct(*rank)).alias("_r")
    return listing.groupBy(F.upper(ticker).alias("ticker")).agg(kept).select("ticker", "_r.*")


def top_bottom_movers(listing: DataFrame, n: int = 5) -> DataFrame:
    """``n`` largest gains and ``n`` smallest, the worst first; two independent top-n reports."""
    known = listing.na.drop(subset=["change_24h"])

    def side(name: str, order: list[Column]) -> DataFrame:
        kept = known.orderBy(*order).limit(n)
        return kept.withColumns({"side": F.lit(name), "place": F.row_number().over(Window.orderBy(*order))})

    gains = side("gainer", [F.desc("change_24h"), F.asc("symbol")])
    return gains.unionByName(side("loser", [F.asc("change_24h"), F.desc("symbol")]))


def heatmap_table(listing: DataFrame, n: int = 30) -> DataFrame:
    known = listing.na.drop(subset=["market_cap", "change_24h"]).orderBy(*by_size()).limit(n)
    label = F.concat(F.upper("symbol"), F.lit("<br>"), signed_pct_text(F.col("change_24h")))
    return known.select(label.alias("label"), "market_cap", "change_24h")


def limit_per_source(articles: DataFrame, order: list[Column], per_source: int = 8, limit: int = 50) -> DataFrame:
    """First rows of every source, then an overall limit in feed order.

    The rank filter is also applied on the map side, so a source that owns much of the input sends only a few rows
    per task.
    """
    first = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    kept = articles.withColumn("_n", first).filter(F.col("_n") <= per_source)
    return kept.orderBy("source", *order).limit(limit).drop("_n")


def market_totals(listing: DataFrame) -> DataFrame:
    """Market-wide numbers of a listing, one row."""
    cap = F.col("market_cap")
    share = F.try_divide(F.sum(F.when(F.col("symbol").startswith("BTC"), cap)), F.sum(cap))
    change = F.try_divide(F.sum(cap * F.coalesce("change_24h", F.lit(0.0))), F.sum(cap))
    return listing.agg(
        F.sum(cap).alias("total_market_cap"),
        F.sum("volume_24h").alias("total_volume_24h"),
        (100 * share).alias("btc_dominance"),
        change.alias("market_cap_change_24h"),
    )


def context_block(
    listing: DataFrame, index: DataFrame, now: str, coins: int = CONTEXT_COINS, unavailable: str = "No market data."
) -> DataFrame:
    """The listing as one text: heading, index, market totals and a line per leading coin.

    ``index`` has one row ``value, label``; an empty listing gives the text ``unavailable``. Only the leading rows are gathered, never the listing itself.
    """
    line = F.concat(
        F.lit("  "), F.upper("symbol"), F.lit(" ("), F.col("symbol"), F.lit(") = "),
        tiered_price_text(F.col("price_usd")), F.lit(" ("), signed_pct_text(F.col("change_24h")), F.lit(" 24h)"),
    )
    leading = market_topn(listing, coins).select("rank", line.alias("line"))
    lines = leading.agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))

    def money(c: str) -> Column:
        return abbrev_money(F.col(c), ("T", "B"))

    head = market_totals(listing).select(
        F.concat(
            F.lit("Global Market Cap: "), money("total_market_cap"), F.lit(" ("),
            signed_pct_text(F.col("market_cap_change_24h")), F.lit(" 24h)\n24h Volume: "), money("total_volume_24h"),
            F.lit("\nBTC Dominance: "), fixed(F.coalesce("btc_dominance", F.lit(0.0)), 1), F.lit("%\n"),
        )
    ).scalar()
    mood = index.select(
        F.concat(F.lit("Fear & Greed Index: "), F.col("value").cast("string"), F.lit("/100 — "), F.col("label"))
    ).scalar()
    text = F.concat_ws(
        "\n", F.lit(f"[LIVE MARKET CONTEXT — {now}]"), mood, head, F.lit("Live Coin Prices:"),
        F.array_join(F.transform("_l", lambda r: r["line"]), "\n"),
    )
    return lines.select(F.when(F.size("_l") > 0, text).otherwise(F.lit(unavailable)).alias("context"))


# Rule limits of the verdict; only the four labels are given by the reports this follows, the limits are our own.
VERDICT_STRONG_SCORE, VERDICT_FEAR, VERDICT_HIGH_VOLATILITY = 0.1, 40, 4.0


def analyst_verdict(score: Column, return_30d: Column, volatility: Column, index: Column) -> Column:
    """Bullish: strong score and rising. Contrarian Buy: falling while the index shows fear and volatility is not
    high. Bearish: weak score and falling. Watch: everything else."""
    return (
        F.when((score >= VERDICT_STRONG_SCORE) & (return_30d > 0), F.lit("Bullish"))
        .when(
            (return_30d <= 0) & (index <= VERDICT_FEAR) & (volatility < VERDICT_HIGH_VOLATILITY),
            F.lit("Contrarian Buy"),
        )
        .when((score < 0) & (return_30d < 0), F.lit("Bearish"))
        .otherwise(F.lit("Watch"))
    )
