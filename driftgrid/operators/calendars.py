"""Calendars and gap classification.

Holidays come from rules, year by year, on the driver; as a DataFrame they hold a few dozen rows for
each year and market, which bounds every broadcast of them.

Defined results: an empty range gives an empty calendar; rows without a date or series are
no observation; repeated observations count once; other columns are not read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)
MON, THU = 0, 3


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday of a month; n = -1 is the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + DAY * ((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - DAY
    return last - DAY * ((last.weekday() - weekday) % 7)


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday by the epact and the golden number."""
    golden = year % 19
    century = year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    full = epact - (epact // 28) * (1 - (29 // (epact + 1)) * ((21 - golden) // 11))
    sunday = full - (year + year // 4 + full + 2 - century + century // 4) % 7
    return dt.date(year, 3, 28) + DAY * sunday


#: One-off closures of the New York exchange, fixed values.
US_ONCE = {dt.date(2012, 10, 29): "storm", dt.date(2012, 10, 30): "storm", dt.date(2018, 12, 5): "mourning", dt.date(2025, 1, 9): "mourning"}
#: One-off Japanese holidays and moved ones, fixed values: year -> {holiday: (month, day)}.
JP_ONCE = {2019: {"abdication": (4, 30), "accession": (5, 1), "accession bridge": (5, 2), "enthronement": (10, 22)}}
JP_MOVED = {2020: {"marine": (7, 23), "sports": (7, 24), "mountain": (8, 10)}, 2021: {"marine": (7, 22), "sports": (7, 23), "mountain": (8, 8)}}


def _us(year: int) -> Iterator[tuple[dt.date, str]]:
    fixed = {"new year": (1, 1), "independence": (7, 4), "veterans": (11, 11), "christmas": (12, 25)}
    if year >= 2021:
        fixed["juneteenth"] = (6, 19)
    for name, (month, day) in fixed.items():
        date = dt.date(year, month, day)
        yield date, name
        if date.weekday() == 5:  # kept the day before
            yield date - DAY, name
        elif date.weekday() == 6:
            yield date + DAY, name
    yield _nth(year, 1, MON, 3), "king"
    yield _nth(year, 2, MON, 3), "presidents"
    yield easter(year) - 2 * DAY, "good friday"
    yield _nth(year, 5, MON, -1), "memorial"
    yield _nth(year, 9, MON, 1), "labor"
    yield _nth(year, 10, MON, 2), "columbus"
    yield _nth(year, 11, THU, 4), "thanksgiving"
    yield from ((d, n) for d, n in US_ONCE.items() if d.year == year)


def _equinox(year: int, base: float) -> int:
    return int(base + 0.242194 * (year - 1980) - (year - 1980) // 4)


def _jp_named(year: int) -> dict[dt.date, str]:
    days = {
        "new year": (1, 1), "foundation": (2, 11), "spring equinox": (3, _equinox(year, 20.8431)), "showa": (4, 29), "constitution": (5, 3),
        "greenery": (5, 4), "children": (5, 5), "autumn equinox": (9, _equinox(year, 23.2488)), "culture": (11, 3), "labour": (11, 23),
    }
    if year <= 2018:
        days["emperor"] = (12, 23)
    elif year >= 2020:
        days["emperor"] = (2, 23)
    if year >= 2016:
        days["mountain"] = (8, 11)
    for name, month, n in (("coming of age", 1, 2), ("marine", 7, 3), ("aged", 9, 3), ("sports", 10, 2)):
        days[name] = (month, _nth(year, month, MON, n).day)
    days |= JP_MOVED.get(year, {}) | JP_ONCE.get(year, {})
    return {dt.date(year, *day): name for name, day in days.items()}


def _jp(year: int) -> Iterator[tuple[dt.date, str]]:
    named = _jp_named(year)
    yield from named.items()
    for date in named:
        if date.weekday() == 6:  # a Sunday's holiday moves to the next free day
            free = date + DAY
            while free in named:
                free += DAY
            yield free, "substitute"
        between = date + DAY
        if between not in named and date + 2 * DAY in named and between.weekday() != 6:
            yield between, "between"
    for month, day in ((12, 31), (1, 2), (1, 3)):  # the bond market's new year
        yield dt.date(year, month, day), "market closed"


@cache
def closures(market: str, year: int) -> dict[dt.date, str]:
    """Closed days of a market that fall in a year."""
    rules = {"us": _us, "jp": _jp}[market]
    found: dict[dt.date, str] = {}
    for y in (year, year + 1):  # a new year's day can be kept the year before
        for date, name in rules(y):
            if date.year == year:
                found.setdefault(date, name)
    return found


def closures_between(market: str, start: dt.date, end: dt.date) -> set[dt.date]:
    return {d for y in range(start.year, end.year + 1) for d in closures(market, y) if start <= d <= end}


def holidays(spark: SparkSession, start: dt.date, end: dt.date, markets: tuple[str, ...] = ("us", "jp")) -> DataFrame:
    """(market, date, name) of the closed days from start to end."""
    rows = [(m, d, n) for m in markets for y in range(start.year, end.year + 1) for d, n in sorted(closures(m, y).items()) if start <= d <= end]
    return spark.createDataFrame(rows, "market string, date date, name string")


def weekday_calendar(spark: SparkSession, start: dt.date, end: dt.date, weekdays: list[int] | None = None) -> DataFrame:
    """(date, back): the days of the mask from start to end, and how many days before each the last one was."""
    mask = weekdays or [0, 1, 2, 3, 4]
    if start > end:
        return spark.createDataFrame([], "date date, back int")
    backs = [next(k for k in range(1, 8) if (w - k) % 7 in mask) for w in range(7)]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")).filter(F.weekday("date").isin(mask))
    return days.select("date", F.element_at(F.array(*map(F.lit, backs)), F.weekday("date") + 1).alias("back"))


def gap_reason(date: Column, holiday: Column, end: dt.date, publication_lag: int) -> Column:
    """Why a day has no observation: a holiday first, then a day not yet published, else unexplained."""
    late = F.lit(publication_lag > 0) & (date > F.date_sub(F.lit(end), publication_lag))
    return F.when(holiday, F.lit("holiday")).when(late, F.lit("publication_lag")).otherwise(F.lit("unexplained"))


def classify_gaps(observations: DataFrame, series: DataFrame, calendar: DataFrame, closed: DataFrame, end: dt.date, publication_lag: int) -> DataFrame:
    """(series, date, reason) of each calendar day on which a series of `series` (series, market) has no value.

    The product has a row for each day and series; the calendar is bounded by the settings' range and goes to every
    task, and the observations are reduced to their keys before they are shuffled.
    """
    wanted = series.select("series", "market").crossJoin(F.broadcast(calendar.select("date")))
    seen = observations.filter(F.col("value").isNotNull()).select("series", F.col("obs_date").alias("date")).distinct()
    missing = wanted.join(seen, ["series", "date"], "left_anti")
    known = closed.select("market", "date", F.lit(True).alias("closed")).distinct()
    found = missing.join(known, ["market", "date"], "left")
    return found.select("series", "date", gap_reason(F.col("date"), F.coalesce("closed", F.lit(False)), end, publication_lag).alias("reason"))


def date_gaps(days: DataFrame, key: list[str], date: str = "date") -> DataFrame:
    """(key, before, date, weekdays_between): rows that follow another by more than the next weekday.

    Weekday numbers count Mondays to Fridays, so a difference is arithmetic; the window is by key.
    """
    ordinal = weekday_ordinal(F.col(date))
    w = Window.partitionBy(*key).orderBy(date)
    rows = days.select(*key, date).distinct().select(*key, F.lag(date).over(w).alias("before"), date)
    rows = rows.withColumn("weekdays_between", (ordinal - weekday_ordinal(F.col("before")) - F.when(F.weekday("before") < 5, 1).otherwise(0)).cast("long"))
    return rows.filter("before is not null and weekdays_between > 0")


def weekday_ordinal(date: Column) -> Column:
    """Weekdays before a date, counted from the Monday 1970-01-05."""
    days = F.datediff(date, F.lit(dt.date(1970, 1, 5)))
    week = F.floor(days / 7)
    return week * 5 + F.least(days - week * 7, F.lit(5))
