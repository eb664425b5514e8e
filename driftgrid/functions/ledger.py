"""Trades out of positions (M14): gaps and islands by window functions alone.

`trades` cuts the rows of a backtest where the side of what is held changes; `trade_figures` sums the ledger up. A position is held from the row after
its decision, so a trade's rows are those that earn its return; what is paid to close it on the row after them counts for it, and where
a position turns round in one row the cost of that row is split by size. So the ledger's sums are those of the backtest.

Defined results: a trade that is open at the end has no exit, and no cost of closing; one that is decided to end on the last row is closed, its
cost still to come; rows without a return add nothing; keys without a trade have no row; rows that tie in `order` are taken in any order;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trades(df: DataFrame, position: str, price: str, key: list[str], order: list[str], reason: str | None = None) -> DataFrame:
    """For each trade of the rows of `backtest`: trade (from 1), side, entry and exit (structs of `order` where decided), reason, rows held, prices, spot, carry, cost, pnl, worst (the least running pnl, 0 at most) and turnover."""
    w = Window.partitionBy(*key).orderBy(*order)
    at = F.struct(*[F.col(c) for c in order])
    rows = df.withColumn("_held", F.coalesce(F.lag(position).over(w), F.lit(0)).cast("double"))
    rows = rows.withColumns({"_was": F.coalesce(F.lag("_held").over(w), F.lit(0.0)), "_entry": F.lag(at).over(w), "_from": F.lag(price).over(w)})
    side, before = F.signum("_held"), F.signum("_was")
    shut = (before != 0) & (side != before)
    moved = F.abs(F.col("_held") - F.col("_was"))
    # of the cost of a row, the part that closes what was held
    part = F.when(shut, F.abs("_was") / moved).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_side": side, "_trade": F.sum(F.when((side != 0) & (side != before), 1).otherwise(0)).over(w), "_shut": part * F.coalesce(F.col("cost"), F.lit(0.0)), "_shut_size": part * moved, "_moved": moved})
    rows = rows.withColumns({"_last_cost": F.coalesce(F.lead("_shut").over(w), F.lit(0.0)), "_last_size": F.coalesce(F.lead("_shut_size").over(w), F.lit(0.0))})
    own = rows.filter("_side <> 0")
    paid = F.coalesce(F.col("cost"), F.lit(0.0)) - F.col("_shut") + F.col("_last_cost")
    gain = F.coalesce(F.col("spot"), F.lit(0.0)) + F.coalesce(F.col("carry_return"), F.lit(0.0)) - paid
    own = own.withColumns({"_paid": paid, "_gain": gain}).withColumn("_running", F.sum("_gain").over(Window.partitionBy(*key, "_trade").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c: F.max_by(c, at)
    closed = last(F.signum(position) != F.col("_side"))
    found = own.groupBy(*key, F.col("_trade").cast("long").alias("trade")).agg(
        F.max("_side").cast("int").alias("side"),
        F.min_by("_entry", at).alias("entry"),
        F.when(closed, F.max(at)).alias("exit"),
        F.when(closed, last(F.col(reason)) if reason else F.lit(None).cast("string")).alias("reason"),
        F.count("*").alias("n_rows"),
        F.min_by("_from", at).alias("entry_price"),
        F.when(closed, last(F.col(price))).alias("exit_price"),
        F.coalesce(F.sum("spot"), F.lit(0.0)).alias("spot"),
        F.coalesce(F.sum("carry_return"), F.lit(0.0)).alias("carry"),
        F.sum("_paid").alias("cost"),
        F.sum("_gain").alias("pnl"),
        F.least(F.min("_running"), F.lit(0.0)).alias("worst"),
        F.sum(F.col("_moved") - F.col("_shut_size") + F.col("_last_size")).alias("turnover"),
    )
    return found


def trade_figures(ledger: DataFrame, key: list[str]) -> DataFrame:
    """For each key: trades, those still open, by reason, hit_rate, mean holding period in rows, mean pnl, profit_factor, spot, carry, cost and turnover; rates are of closed trades."""
    closed = F.col("exit").isNotNull()
    won, lost = F.when(closed & (F.col("pnl") > 0), F.col("pnl")), F.when(closed & (F.col("pnl") < 0), -F.col("pnl"))
    n = F.nullif(F.count_if(closed), F.lit(0))
    return ledger.groupBy(*key).agg(
        F.count("*").alias("n_trades"),
        F.count_if(~closed).alias("n_open"),
        F.count_if(F.col("side") > 0).alias("n_long"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("exit", "stop", "time")],
        (F.count(won) / n).alias("hit_rate"),
        (F.sum(F.when(closed, F.col("n_rows"))) / n).alias("mean_rows"),
        (F.sum(F.when(closed, F.col("pnl"))) / n).alias("mean_pnl"),
        (F.sum(won) / F.nullif(F.sum(lost), F.lit(0.0))).alias("profit_factor"),
        *[F.sum(c).alias(c) for c in ("spot", "carry", "cost", "pnl", "turnover")],
        F.min("worst").alias("worst"),
    )
