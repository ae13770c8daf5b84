"""Positions kept as a log of changes; the current state is an aggregation over the log.

Log columns: ``seq, op (add/update/delete/clear), id, coin, qty, buy_price, added_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.guards import ratio


def positions_current(log: DataFrame) -> DataFrame:
    """State after replaying the log. Ids are added once and never reused.

    Per id it is enough to know the add, the last update and the last delete: if any update follows the add, the last
    one does, and a row that was deleted after its add stays gone. All of it combines on the map side.
    """

    def of(op: str):
        return F.col("op") == op

    change = F.struct("seq", "qty", "buy_price")
    per_id = (
        log.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.min_by(F.when(of("add"), F.struct("seq", "coin", "qty", "buy_price", "added_at")),
                     F.when(of("add"), F.col("seq"))).alias("a"),
            F.max_by(F.when(of("update"), change), F.when(of("update"), F.col("seq"))).alias("u"),
            F.max(F.when(of("delete"), F.col("seq"))).alias("deleted"),
        )
    )
    cleared = log.filter(of("clear")).agg(F.max("seq")).scalar()
    never = F.lit(-1).cast("bigint")
    alive = F.col("a.seq") > F.greatest(F.coalesce("deleted", never), F.coalesce(cleared, never))
    updated = F.col("u.seq") > F.col("a.seq")
    return per_id.filter(alive).select(
        "id",
        "a.coin",
        F.when(updated, F.col("u.qty")).otherwise(F.col("a.qty")).alias("qty"),
        F.when(updated, F.col("u.buy_price")).otherwise(F.col("a.buy_price")).alias("buy_price"),
        "a.added_at",
    )


def position_count(log: DataFrame) -> DataFrame:
    return positions_current(log).agg(F.count(F.lit(1)).alias("position_count"))


def join_prices(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach ``price_usd`` by coin. No hint: the engine broadcasts the prices if they turn out small and otherwise
    sorts and merges, splitting a coin that holds many positions."""
    return positions.join(prices.select(F.col("symbol").alias("coin"), "price_usd"), "coin", "left")


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost, value, profit and its percentage per position; unpriced positions have no value."""
    qty, buy, live = F.col("qty"), F.col("buy_price"), F.col("price_usd")
    return join_prices(positions, prices).withColumns(
        {
            "cost": qty * buy,
            "value": qty * live,
            "pnl": (live - buy) * qty,
            "pnl_pct": ratio((live - buy) * F.lit(100.0), buy, None),
        }
    )


def portfolio_totals(marked: DataFrame) -> DataFrame:
    sums = marked.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("invested"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("current_value"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"),
        F.count(F.lit(1)).alias("n_positions"),
    )
    return sums.withColumn("pnl_pct", ratio(F.col("pnl") * 100, F.col("invested")))


def allocation(marked: DataFrame) -> DataFrame:
    """Share of total value per coin; the total is a scalar subquery, not an unpartitioned window."""
    total = marked.agg(F.sum("value")).scalar()
    by_coin = marked.groupBy("coin").agg(F.sum("value").alias("value"))
    return by_coin.withColumn("share", ratio(F.col("value"), total, None))
