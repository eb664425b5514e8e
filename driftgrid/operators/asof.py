"""As-of and exact lookups.

With a tolerance, an observation is valid for the days from its own to max_lag later. Observations that no
target can read are left out first (by the first and last target: given, or one row). Each of the rest is spread
over its days and the latest one for each (series, day) is kept by an aggregation: a plain equality
join follows, no series is ever in one task, and a hot series costs what its rows cost. That multiplies rows by the
tolerance, so for a tolerance of more than `SPREAD` days the way without one is taken, and what is too old is left out.
Without a tolerance, series are cut into months; a window over the months' last values carries them on,
and a window within each month does the rest.

Defined results: null values are no observation; a tie on the day goes to the greatest ordinal, then the greatest value; a null
target day or series finds nothing; repeated targets are answered each; empty tables give null values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The longest tolerance in days for which observations are spread.
SPREAD = 31


def _last_of_day(observations: DataFrame, *also: str) -> DataFrame:
    """The last value of each series and day; `also` are columns that a series has one value of."""
    rank = [F.col("ordinal")] if "ordinal" in observations.columns else []
    best = observations.filter("value is not null and obs_date is not null").groupBy("series", "obs_date", *also).agg(F.max(F.struct(*rank, "value")).alias("r"))
    return best.select("series", "obs_date", *also, F.col("r.value").alias("value"))


def asof_lookup(targets: DataFrame, observations: DataFrame, policy: DataFrame, longest: int | None = None, between: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """targets (series, target, ...) with obs_date and value of the latest observation up to max_lag days before.

    policy is (series, max_lag), one row for each series; a lag of 0 is the exact lookup. The join with it is left to
    the optimiser, which broadcasts it by its size. longest is the longest max_lag, and between the first and last target, if the caller
    knows them: then the targets are read once, and the days reach the scan of the observations as a filter.
    """
    if longest is not None and longest > SPREAD:
        found = asof_unbounded(targets, observations).join(policy.select("series", "max_lag"), "series", "left")
        near = F.datediff("target", "obs_date") <= F.col("max_lag")
        return found.select(*targets.columns, F.when(near, F.col("obs_date")).alias("obs_date"), F.when(near, F.col("value")).alias("value"))
    if between and longest is not None:
        observations = observations.filter(F.col("obs_date").between(between[0] - dt.timedelta(days=longest), between[1]))
    lagged = observations.join(policy.select("series", "max_lag"), "series")
    if not between:
        span = targets.agg(F.min("target").alias("_first"), F.max("target").alias("_last"))
        # the span is one row
        lagged = lagged.join(F.broadcast(span), F.col("obs_date").between(F.date_sub("_first", F.col("max_lag")), F.col("_last"))).drop("_first", "_last")
    spread = _last_of_day(lagged, "max_lag").select("series", "obs_date", "value", F.explode(F.sequence("obs_date", F.date_add("obs_date", F.col("max_lag")))).alias("target"))
    valid = spread.groupBy("series", "target").agg(F.max(F.struct("obs_date", "value")).alias("_o"))
    found = targets.join(valid, ["series", "target"], "left")
    return found.select(*targets.columns, F.col("_o.obs_date").alias("obs_date"), F.col("_o.value").alias("value"))


def asof_unbounded(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """targets (series, target, ...) with the latest observation at any distance before."""
    points = _last_of_day(observations).select("series", F.col("obs_date").alias("at"), F.struct("obs_date", "value").alias("o"))
    wanted = targets.select("series", F.col("target").alias("at")).distinct().select("series", "at", F.lit(None).cast(points.schema["o"].dataType).alias("o"))
    both = points.withColumn("kind", F.lit(0)).unionByName(wanted.withColumn("kind", F.lit(1))).withColumn("month", F.trunc("at", "month"))
    last = both.groupBy("series", "month").agg(F.max("o").alias("o"))
    carry = Window.partitionBy("series").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("series", "month", F.last("o", ignorenulls=True).over(carry).alias("carried"))
    inside = Window.partitionBy("series", "month").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.join(carried, ["series", "month"]).select("series", "at", "kind", F.coalesce(F.last("o", ignorenulls=True).over(inside), "carried").alias("o"))
    answers = filled.filter("kind = 1").select("series", F.col("at").alias("target"), F.col("o.obs_date").alias("obs_date"), F.col("o.value").alias("value"))
    return targets.join(answers, ["series", "target"], "left").select(*targets.columns, "obs_date", "value")
