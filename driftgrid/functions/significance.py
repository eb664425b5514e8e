"""How much of a Sharpe ratio is luck (M14): block bootstrap, and the ratio deflated by the number of trials.

`bootstrap_sharpe` needs no row of a series twice: the sums of every block of consecutive returns (round the end to the start) are window
sums, a replicate is a choice of blocks, and so replicates are rows of a join that spreads over tasks. Choices are digests of
seed, key, replicate and place: the same on every run and for any partitioning.

The normal distribution and its inverse are expressions, as Spark has neither.

Defined results: null returns are left out; a key with under two returns or no spread has a null ratio; one trial, or trials without spread, expect
nothing of the greatest; rows that tie in `order` are taken in any order; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The published rational approximation of the normal distribution (numerator, denominator), highest power first.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: The published rational approximation of its inverse, in the middle (A over B) and in the tails (C over D), highest power first.
INVERSE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INVERSE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
INVERSE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INVERSE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL, FAR, EULER = 0.02425, 7.07106781186547, 0.5772156649015329


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + F.lit(c)
    return out


def _of(value: Column, formula: Callable[[Column], Column]) -> Column:
    """formula(value), with the value computed once however often the formula names it."""
    return F.transform(F.array(value), formula)[0]


def normal_cdf(x: Column) -> Column:
    """The chance that a standard normal number is at most x, to about 1e-15."""
    return _of(x.cast("double"), _cdf)


def _cdf(x: Column) -> Column:
    size = F.abs(x)
    bell = F.exp(-size * size / 2)
    far = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = size + F.lit(k) / far
    above = F.when(size < FAR, bell * _polynomial(size, CDF_TOP) / _polynomial(size, CDF_BOTTOM)).otherwise(bell / far / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1 - above).otherwise(above)


def normal_inverse(p: Column) -> Column:
    """The x with normal_cdf(x) = p, to about 1e-9; null outside (0, 1)."""
    return _of(p.cast("double"), lambda p: F.when((p > 0) & (p < 1), _inverse(p)))


def _inverse(p: Column) -> Column:
    middle = _of(p - 0.5, lambda q: q * _polynomial(q * q, INVERSE_A) / _polynomial(q * q, INVERSE_B))
    tail = _of(F.sqrt(-2 * F.ln(F.least(p, 1 - p))), lambda r: _polynomial(r, INVERSE_C) / _polynomial(r, INVERSE_D))
    return F.when(F.least(p, 1 - p) >= TAIL, middle).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def expected_greatest(n: Column, spread: Column) -> Column:
    """The greatest of n independent ratios without merit that have this standard deviation, on average."""
    n = n.cast("double")
    value = spread * ((1 - EULER) * normal_inverse(1 - 1 / n) + EULER * normal_inverse(1 - 1 / (n * math.e)))
    return F.when(n > 1, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def probabilistic_sharpe(sharpe: Column, n: Column, skewness: Column, kurtosis: Column, against: Column) -> Column:
    """The chance that the true ratio of a row is above `against`, given that of n returns with this skewness and (plain) kurtosis."""
    width = 1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return F.when((n > 1) & (width > 0), normal_cdf((sharpe - against) * F.sqrt(n - 1) / F.sqrt(width)))


def deflated_sharpe(cells: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """For each key of the cells of `sweep`: the best cell's ratio, the trials, the greatest ratio they would show without merit, and the chance that the best one is above it.

    Cells without a ratio are no trials; of equal cells the first by `ties` counts.
    """
    best = F.max_by(F.struct("sharpe", "n", "skewness", "kurtosis", *ties), F.struct("sharpe", *[-F.col(t) for t in ties]))
    known = cells.filter(F.col("sharpe").isNotNull())
    found = known.groupBy(*key).agg(F.count("*").alias("n_trials"), F.stddev_samp("sharpe").alias("spread"), best.alias("_b"))
    found = found.select(*key, "n_trials", "spread", "_b.*").withColumn("expected", expected_greatest(F.col("n_trials"), F.col("spread")))
    chance = probabilistic_sharpe(F.col("sharpe"), F.col("n"), F.col("skewness"), F.col("kurtosis"), F.col("expected"))
    return found.withColumns({"deflated": chance, "undeflated": probabilistic_sharpe(F.col("sharpe"), F.col("n"), F.col("skewness"), F.col("kurtosis"), F.lit(0.0))})


def _draw(seed: int, parts: list[Column], n: Column) -> Column:
    """A number below n from a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n)


def bootstrap_replicates(df: DataFrame, value: str, key: list[str], order: list[str], draws: int, block: int, seed: int) -> DataFrame:
    """(key, draw, n, s1, s2): the sums of the returns of each replicate, ceil(n / block) blocks of `block` consecutive returns each."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.filter(F.col(value).isNotNull()).select(*key, *order, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumns({"_i": F.row_number().over(w).cast("long") - 1, "_n": F.count("*").over(Window.partitionBy(*key))})
    # the first rows again behind the last, as often as a block that is longer than the series needs them
    turns = F.sequence(F.lit(0), F.ceil((F.lit(block) - F.col("_i") - 1) / F.col("_n")).cast("int"))
    ring = rows.select(*key, "_v", "_n", "_i", F.explode(F.when(F.col("_i") < block - 1, turns).otherwise(F.array(F.lit(0)))).alias("_turn")).withColumn("_at", F.col("_i") + F.col("_turn") * F.col("_n"))
    along = Window.partitionBy(*key).orderBy("_at").rowsBetween(0, block - 1)
    ring = ring.withColumns({"_s1": F.sum("_v").over(along), "_s2": F.sum(F.col("_v") * F.col("_v")).over(along)})
    blocks = ring.filter("_turn = 0").select(*key, F.col("_i").alias("_start"), "_s1", "_s2")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    picks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)))
    picks = picks.withColumn("_start", _draw(seed, [*[F.col(k) for k in key], F.col("draw"), F.col("_slot")], F.col("_n")))
    return picks.join(blocks, [*key, "_start"]).groupBy(*key, "draw").agg((F.count("*") * block).alias("n"), F.sum("_s1").alias("s1"), F.sum("_s2").alias("s2"))


def _ratio(n: Column, s1: Column, s2: Column, per_year: int) -> Column:
    mean = s1 / n
    spread = (s2 - s1 * mean) / F.nullif(n - 1, F.lit(0))
    return F.when(spread > 1e-15 * s2 / n, mean / F.sqrt(spread) * math.sqrt(per_year))


def bootstrap_sharpe(df: DataFrame, value: str, key: list[str], order: list[str], draws: int = 1000, block: int = 20, seed: int = 7, level: float = 0.9, per_year: int = 252) -> DataFrame:
    """For each key: the yearly sharpe, its interval over `draws` replicates, and the share of replicates that are not above 0."""
    v = F.col(value).cast("double")
    whole = df.filter(v.isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), _ratio(F.count("*"), F.sum(v), F.sum(v * v), per_year).alias("sharpe"))
    made = bootstrap_replicates(df, value, key, order, draws, block, seed).select(*key, _ratio(F.col("n"), F.col("s1"), F.col("s2"), per_year).alias("_r"))
    at: Callable[[float], Column] = lambda q: F.percentile("_r", F.lit(q))
    found = made.groupBy(*key).agg(F.count("_r").alias("n_draws"), at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"), (F.count_if(F.col("_r") <= 0) / F.nullif(F.count("_r"), F.lit(0))).alias("share_not_positive"))
    return whole.join(found, key, "left")
