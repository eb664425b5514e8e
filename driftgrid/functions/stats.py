"""Statistics by window and aggregation, of past rows alone where they roll.

Rolling figures are window aggregations that end at the row before; they run by `key`, so series
are spread over tasks.

Defined results: null values take no part in a regression but hold their place in a window of rows; a window that is not full, without spread in x, or
degenerate in another way gives null, never NaN; rows that tie in `order` are windowed in any order, so an order should be
unique in its key; repeated rows count each; an empty table gives an empty one.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def past(key: list[str], order: list[str], rows: int) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(-rows, -1)


def full(value: Column, w: WindowSpec, rows: int) -> Column:
    """value where the window is full."""
    return F.when(F.count(F.lit(1)).over(w) == rows, value)


def rolling_ols(df: DataFrame, y: str, x: str, key: list[str], order: list[str], rows: int) -> DataFrame:
    """slope, intercept and r2 of y on x over the rows before."""
    w = past(key, order, rows)
    fits = {n: full(f(y, x).over(w), w, rows) for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))}
    return df.withColumns(fits)


def rolling_zscore(df: DataFrame, value: str, key: list[str], order: list[str], rows: int) -> DataFrame:
    """z: the distance of a row from the mean of the rows before it, in their standard deviations."""
    w = past(key, order, rows)
    return df.withColumn("z", full((F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)), w, rows))


def fit(df: DataFrame, y: str, x: str, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def residual(df: DataFrame, y: str, x: str) -> DataFrame:
    """fair and residual from slope and intercept (M3)."""
    return df.withColumn("fair", F.col("intercept") + F.col("slope") * F.col(x)).withColumn("residual", F.col(y) - F.col("fair"))


def half_life(df: DataFrame, value: str, key: list[str], order: list[str]) -> DataFrame:
    """kappa and half_life: the change of a value against the value before it; null unless it reverts."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    steps = df.select(*key, before.alias("_x"), (F.col(value) - before).alias("_y"))
    found = steps.groupBy(*key).agg(F.regr_slope("_y", "_x").alias("kappa"), F.regr_count("_y", "_x").alias("n"))
    return found.withColumn("half_life", F.when(F.col("kappa") < 0, F.lit(-math.log(2)) / F.col("kappa")))


def chow(df: DataFrame, y: str, x: str, date: str, split: dt.date, key: list[str]) -> DataFrame:
    """f: whether y on x has one line or two, before and from `split` on; one aggregation."""
    early = F.col(date) < F.lit(split)
    parts = {"all": F.lit(True), "old": early, "new": ~early}
    sums = []
    for name, when in parts.items():
        a, b = F.when(when, F.col(y)), F.when(when, F.col(x))
        sums.append((F.regr_syy(a, b) - F.regr_sxy(a, b) * F.regr_sxy(a, b) / F.nullif(F.regr_sxx(a, b), F.lit(0.0))).alias(f"rss_{name}"))
    out = df.groupBy(*key).agg(F.regr_count(y, x).alias("n"), *sums)
    apart = F.col("rss_old") + F.col("rss_new")
    return out.withColumn("f", F.when(F.col("n") > 4, ((F.col("rss_all") - apart) / 2) / F.nullif(apart / (F.col("n") - 4), F.lit(0.0))))


def walk_forward(df: DataFrame, y: str, x: str, key: list[str], block: str) -> DataFrame:
    """df with slope, intercept and residual of the line fitted to all blocks before a row's own (M14); null in the first.

    Sums of each block are added up over the blocks before, so no row is fitted twice.
    """
    known = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(known, F.col(x)), F.when(known, F.col(y))
    sums = {"_n": F.count(a), "_x": F.sum(a), "_y": F.sum(b), "_xx": F.sum(a * a), "_xy": F.sum(a * b)}
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*key, block).agg(*[c.alias(n) for n, c in sums.items()])
    blocks = blocks.select(*key, block, *[F.sum(n).over(before).alias(n) for n in sums])
    spread = F.nullif(F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0.0))
    slope = (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / spread
    fits = blocks.select(*key, block, slope.alias("slope"), ((F.col("_y") - slope * F.col("_x")) / F.col("_n")).alias("intercept"))
    return residual(df.join(fits, [*key, block]), y, x).drop("fair")


def anchor_checks(df: DataFrame, value: str, date: str, key: list[str], anchors: list[tuple[str, dt.date, dt.date, int]]) -> DataFrame:
    """(key, anchor, n, mean, ok): whether a value has the expected sign, on average, in spans of days that are known (M12); ok is null without rows."""
    rows = []
    for name, start, end, sign in anchors:
        inside = F.when(F.col(date).between(start, end), F.col(value))
        rows.append(F.struct(F.lit(name).alias("anchor"), F.count(inside).alias("n"), F.avg(inside).alias("mean"), (F.signum(F.avg(inside)) == sign).alias("ok")))
    return df.groupBy(*key).agg(F.array(*rows).alias("_a")).select(*key, F.explode("_a").alias("_a")).select(*key, "_a.*")
