"""Signals, returns and their documents.

Defined results: a null z-score leaves a position as it is, but for the rows held; the first row of a key has no return; rows that tie in `order`
are taken in any order; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Thresholds on |z|, and the most rows that a position is held."""

    enter: float = 2.0
    leave: float = 0.25
    stop: float = 3.5
    most_rows: int = 60


def step(position: int, held: int, barred: bool, value: float | None, rules: Rules) -> tuple[int, int, bool, str | None]:
    """position, rows held, whether barred and the reason after a row with the z-score `value`: the one rule of the fold and of the daily run."""
    known = value is not None and not math.isnan(value)
    size, reason = abs(value) if known else 0.0, None
    if position:
        held += 1
        reason = "stop" if known and size >= rules.stop else "exit" if known and size <= rules.leave else "time" if held >= rules.most_rows else None
        position = position if reason is None else 0
    elif known and rules.enter <= size < rules.stop and not barred:
        position, held, reason = -1 if value > 0 else 1, 0, "enter"
    return position, held, reason == "stop" or barred and not (known and size <= rules.leave), reason


def signal_states(df: DataFrame, z: str, key: list[str], order: list[str], enter: float = 2.0, leave: float = 0.25, stop: float = 3.5, most_rows: int = 60) -> DataFrame:
    """position (-1, 0, 1) and reason after each row: a fold in order within a key.

    A position opens against z at `enter`, closes at `leave`, at `stop`, or after most_rows rows; after a
    stop it opens again only once |z| has been under `leave`. One key's rows, a row a day, are one group, read once.
    """
    kinds, rules = dict(df.dtypes), Rules(enter, leave, stop, most_rows)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        position, held, barred = 0, 0, False
        positions, reasons = [], []
        for value in group["z"].tolist():
            position, held, barred, reason = step(position, held, barred, value, rules)
            positions.append(position)
            reasons.append(reason)
        return group[[*key, *order, "z"]].assign(position=positions, reason=reasons)

    rows = df.select(*key, *order, F.col(z).cast("double").alias("z"))
    return rows.groupBy(*key).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*key, *order]), "z double, position int, reason string"]))


def volatility_scaled(df: DataFrame, position: str, price: str, key: list[str], order: list[str], target: float = 0.1, rows: int = 60, most: float = 3.0, per_year: int = 252) -> DataFrame:
    """df with size: the position times the yearly volatility aimed at, over that of the price in the `rows` returns up to the row, `most` at most.

    A size is decided on its own row and held from the next one on, so the return of the row may count. Without a full window, or without
    movement, the position itself stays.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    moved = df.withColumn("_move", F.col(price) / F.nullif(F.lag(price).over(w), F.lit(0.0)) - 1)
    inside = w.rowsBetween(1 - rows, 0)
    sd = F.when(F.count("_move").over(inside) == rows, F.stddev_samp("_move").over(inside))
    scale = F.when(sd > 0, F.least(F.lit(target) / (sd * math.sqrt(per_year)), F.lit(most))).otherwise(F.lit(1.0))
    return moved.withColumn("size", F.col(position) * scale).drop("_move")


def backtest(df: DataFrame, position: str, price: str, key: list[str], order: list[str], carry: str | None = None, cost_bps: float = 1.0, per_year: int = 252) -> DataFrame:
    """df with spot, carry_return, cost and value, the return of a row.

    A position is held from the row after the one that decided it, so a row uses nothing of its own: the price moves from the row before,
    the yearly carry in percent is that of the row before, and costs are paid on the change of what is held.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    held = F.coalesce(F.lag(position).over(w), F.lit(0))
    rows = df.withColumns({"_held": held, "_price": F.lag(price).over(w), "_carry": F.coalesce(F.lag(carry).over(w), F.lit(0.0)) if carry else F.lit(0.0)})
    rows = rows.withColumn("_was", F.coalesce(F.lag("_held").over(w), F.lit(0)))
    rows = rows.withColumns({"spot": F.col("_held") * (F.col(price) / F.nullif(F.col("_price"), F.lit(0.0)) - 1), "carry_return": F.col("_held") * F.col("_carry") / 100 / per_year, "cost": F.abs(F.col("_held") - F.col("_was")) * cost_bps / 1e4})
    return rows.withColumn("value", F.col("spot") + F.col("carry_return") - F.col("cost")).drop("_held", "_price", "_carry", "_was")


def drawdown(df: DataFrame, value: str, key: list[str], order: list[str]) -> DataFrame:
    """equity, peak and drawdown of summed returns."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.sum(value).over(w))
    return out.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0))).withColumn("drawdown", F.col("equity") - F.col("peak"))


def performance(df: DataFrame, value: str, key: list[str], order: list[str], per_year: int = 252) -> DataFrame:
    """n, mean, sharpe, sortino, growth a year, max_drawdown, hit_rate, exposure and profit_factor of returns (M14); null where a figure has no base."""
    rows = drawdown(df, value, key, order)
    v, root = F.col(value), math.sqrt(per_year)
    down = F.sqrt(F.avg(F.pow(F.least(v, F.lit(0.0)), 2)))
    lost = F.sum(F.when(v < 0, -v))
    return rows.groupBy(*key).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.avg(v) / F.nullif(F.stddev_samp(v), F.lit(0.0)) * root).alias("sharpe"),
        (F.avg(v) / F.nullif(down, F.lit(0.0)) * root).alias("sortino"),
        (F.exp(F.avg(F.log1p(F.when(v > -1, v))) * per_year) - 1).alias("growth"),
        F.min("drawdown").alias("max_drawdown"),
        (F.count_if(v > 0) / F.nullif(F.count_if(v != 0), F.lit(0))).alias("hit_rate"),
        (F.count_if(v != 0) / F.nullif(F.count(v), F.lit(0))).alias("exposure"),
        (F.sum(F.when(v > 0, v)) / F.nullif(lost, F.lit(0.0))).alias("profit_factor"),
    )


def signal_documents(rows: DataFrame, key: list[str], date: str, lags: dict[str, int], failed: Column, figures: list[str]) -> DataFrame:
    """(key, date, state, action, document) of the last row of each key, with position and reason.

    lags names columns and the most days that each may be old; `failed` says that the regime is not trusted. Then nothing is
    acted on: the state is flat and the warnings say why.
    """
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in key]), F.col(date)).alias("_r")).select(*key, "_r.*")
    stale = F.filter(F.array(*[F.when(F.coalesce(F.col(c) > most, F.lit(True)), F.lit(c)) for c, most in lags.items()]) if lags else F.array().cast("array<string>"), lambda c: c.isNotNull())
    warnings_ = F.filter(F.array(F.when(F.size(stale) > 0, F.lit("stale inputs")), F.when(F.coalesce(failed, F.lit(True)), F.lit("regime not trusted"))), lambda c: c.isNotNull())
    guarded = F.size(warnings_) > 0
    side = F.when(F.col("position") > 0, F.lit("LONG")).otherwise(F.lit("SHORT"))
    state = F.when(guarded | (F.col("position") == 0), F.lit("FLAT")).otherwise(side)
    action = F.when(guarded | F.col("reason").isNull(), F.lit("NONE")).when(F.col("reason") == "enter", F.concat(F.lit("ENTER_"), side)).when(F.col("reason") == "stop", F.lit("STOP")).otherwise(F.lit("EXIT"))
    out = last.withColumns({"_warnings": warnings_, "_stale": stale, "state": state, "action": action})
    document = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.col(date).alias("as_of"), *[F.col(k) for k in key], *[F.col(c) for c in figures], "state", "action", F.struct(F.col("_stale").alias("stale_inputs"), F.col("_warnings").alias("warnings")).alias("data_quality")))
    return out.select(*key, date, "state", "action", document.alias("document"))
