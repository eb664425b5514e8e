"""Validation of a daily table: findings and figures, never repairs.

Checks of values share one aggregation over the table; days found twice and gaps are aggregated from its distinct
days, which are persisted for it. Findings are a DataFrame (level, check, subject, n, message), so they can be queried, kept and compared.
Rows are compared with the row before them in ranges of their order: a window in each range, and the last row of each
range carried to the next, so no window holds a whole table.

Defined results: an empty table gives a `rows` finding and null figures; a day outside the weekday calendar is a finding of its own
and does not count in gaps; missing required columns end the checks; a null value is reported by
`nan` and, where it breaks a spread, by `consistency`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LAGS, OPTIONAL, REQUIRED, SPREADS, Config
from .calendars import weekday_ordinal

FINDINGS = "level string, check string, subject string, n long, message string"
MOST_GAPS, EXAMPLES = 20, 3
#: Tolerances of the spread check, fixed values.
ABSOLUTE, RELATIVE = 1e-9, 1e-5


@dataclass
class Result:
    findings: DataFrame
    stats: dict

    def rows(self) -> list:
        return self.findings.orderBy("level", "check", "subject").collect()

    @property
    def ok(self) -> bool:
        return not self.findings.filter("level = 'error'").head(1)


def differs(a: Column, b: Column) -> Column:
    """a is not b within the tolerances; null equals null alone."""
    far = ~(F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b))
    return F.when(a.isNull() & b.isNull(), False).otherwise(F.coalesce(far, F.lit(True)))


def outside(column: str, lo: float, hi: float) -> Column:
    return F.coalesce((F.col(column) < lo) | (F.col(column) > hi), F.lit(False))


def duplicate_dates(daily: DataFrame, key: str = "date") -> DataFrame:
    """(date, n) of days found more than once (H4)."""
    return daily.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def with_before(df: DataFrame, value: str, order: str, ranges: Column) -> DataFrame:
    """df with `before`, the value of the row before each by `order`; ranges numbers stretches of that order."""
    inside = Window.partitionBy("_range").orderBy(order)
    rows = df.withColumn("_range", ranges)
    rows = rows.withColumns({"_at": F.row_number().over(inside), "_own": F.lag(value).over(inside)})
    ends = df.select(ranges.alias("_range"), value, order).groupBy("_range").agg(F.max_by(value, order).alias("_end"))
    # a row for each range
    carried = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_carried"))
    found = rows.join(carried, rows["_range"].eqNullSafe(carried["_range"]), "left").drop(carried["_range"])
    return found.withColumn("before", F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_own"))).drop("_range", "_at", "_own", "_carried")


def gaps(daily: DataFrame) -> DataFrame:
    """(before, date, n): weekdays missing between neighbouring days."""
    days = daily.filter(F.weekday("date") < 5).select(F.col("date").cast("date").alias("date")).distinct()
    out = with_before(days, "date", "date", F.year("date"))
    return out.select("before", "date", (weekday_ordinal(F.col("date")) - weekday_ordinal(F.col("before")) - 1).cast("long").alias("n")).filter("n > 0")


def unsorted_rows(daily: DataFrame, ordinal: str, stretch: int = 1_000_000) -> DataFrame:
    """Rows whose day is before that of the row before them by a stored ordinal, a number."""
    return with_before(daily, "date", ordinal, F.floor(F.col(ordinal) / stretch)).filter("date < before").drop("before")


def validate(daily: DataFrame, config: Config, metadata: dict | None = None, ordinal: str | None = None) -> Result:
    """All checks of a daily table; ordinal names a column that keeps the order in which its rows were stored (H5)."""
    spark, rules = daily.sparkSession, config.validation
    found: list[tuple] = []

    def add(level: str, check: str, subject: str, n: int, message: str) -> None:
        found.append((level, check, subject, int(n), message))

    columns = daily.columns
    kinds = dict(daily.dtypes)
    need = ["date", *REQUIRED, *SPREADS]
    if missing := [c for c in need if c not in columns]:
        add("error", "schema", ",".join(missing), len(missing), f"missing columns: {', '.join(missing)}")
        return Result(spark.createDataFrame(found, FINDINGS), {})
    if kinds["date"] != "date":
        add("error", "schema", "date", 1, f"date is a {kinds['date']}")
    if ordinal and (late := unsorted_rows(daily, ordinal).count()):
        add("error", "dates", "order", late, f"{late} rows are before the row stored before them")
    if extra := [c for c in columns if c not in {*need, *OPTIONAL, *LAGS, ordinal}]:
        add("warning", "schema", ",".join(extra), len(extra), f"unexpected columns: {', '.join(extra)}")
    figures, optional = [*REQUIRED, *SPREADS], [c for c in OPTIONAL if c in columns]
    lags = [c for c in LAGS if c in columns]
    bounded = {c: b for c, b in rules.bounds.items() if c in columns}
    exprs = [F.count("*").alias("rows"), F.min("date").cast("date").alias("first"), F.max("date").cast("date").alias("last"), F.count_if(F.weekday("date") >= 5).alias("off_calendar")]
    if kinds["date"].startswith("timestamp"):
        exprs.append(F.count_if(F.col("date") != F.date_trunc("day", "date")).alias("time_of_day"))
    for c in [*figures, *optional]:
        exprs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for c, (lo, hi) in bounded.items():
        exprs += [F.count_if(outside(c, lo, hi)).alias(f"out_{c}"), F.min_by(F.when(outside(c, lo, hi), F.struct("date", c)), F.when(outside(c, lo, hi), F.col("date"))).alias(f"first_{c}")]
    for s, (a, b) in SPREADS.items():
        exprs.append(F.count_if(differs(F.col(a) - F.col(b), F.col(s))).alias(f"spread_{s}"))
    for c in lags:
        exprs += [F.count_if(F.col(c) < 0).alias(f"neg_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 3).alias(f"mean_{c}")]
    s = daily.agg(*exprs).first().asDict()

    days = daily.groupBy("date").agg(F.count("*").alias("n")).persist()
    double = days.filter("n > 1")
    if repeated := double.count():
        shown = [str(r["date"]) for r in double.orderBy("date").limit(EXAMPLES).collect()]
        add("error", "dates", "date", repeated, f"{repeated} days are repeated, such as {', '.join(shown)}")
    if s.get("time_of_day"):
        add("error", "dates", "date", s["time_of_day"], "dates have a time of day")
    if s["off_calendar"]:
        add("error", "dates", "weekend", s["off_calendar"], f"{s['off_calendar']} rows are off the weekday calendar")
    if s["rows"] < rules.min_rows:
        add("error", "rows", "table", s["rows"], f"{s['rows']} rows; {rules.min_rows} are needed")
    if s["rows"]:
        if s["first"] > rules.required_start_before:
            add("error", "coverage", "start", 1, f"starts on {s['first']}, after {rules.required_start_before}")
        stale = (config.project.end - s["last"]).days
        if stale > rules.max_days_stale_end:
            add("error", "coverage", "end", stale, f"ends on {s['last']}, {stale} days before the end")
    for c in [*figures, *optional]:
        if s[f"null_{c}"]:
            add("error" if c in figures else "warning", "nan", c, s[f"null_{c}"], f"{c} is missing in {s[f'null_{c}']} rows")
    for c, (lo, hi) in bounded.items():
        if s[f"out_{c}"]:
            example = s[f"first_{c}"]
            add("error", "bounds", c, s[f"out_{c}"], f"{c} is outside {lo} to {hi} in {s[f'out_{c}']} rows, first {example[1]} on {example[0]}")
    for c in SPREADS:
        if s[f"spread_{c}"]:
            add("error", "consistency", c, s[f"spread_{c}"], f"{c} is not the difference of its legs in {s[f'spread_{c}']} rows")
    for c in lags:
        if s[f"neg_{c}"]:
            add("error", "lags", c, s[f"neg_{c}"], f"{c} is negative in {s[f'neg_{c}']} rows")
    wide = gaps(days)
    largest = wide.agg(F.max("n").alias("n"), F.sum("n").alias("total")).first()
    too_wide = wide.filter(F.col("n") > rules.max_gap_business_days)
    n = too_wide.count() if (largest["n"] or 0) > rules.max_gap_business_days else 0
    for r in too_wide.orderBy("date").limit(MOST_GAPS).collect() if n else []:
        add("error", "gaps", str(r["date"]), r["n"], f"{r['n']} weekdays are missing between {r['before']} and {r['date']}")
    if n > MOST_GAPS:
        add("error", "gaps", "more", n - MOST_GAPS, f"and {n - MOST_GAPS} more gaps")
    days.unpersist()
    for name, have, level in (("row_count", s["rows"], "error"), ("convention", config.alignment.convention, "warning")):
        if metadata and name in metadata and metadata[name] != have:
            add(level, "metadata", name, 1, f"{name} is {have} but recorded as {metadata[name]}")
    stats = {"rows": s["rows"], "first": s["first"], "last": s["last"], "largest_gap": largest["n"] or 0}
    if s["rows"]:
        expected = spark.range(1).select((weekday_ordinal(F.lit(s["last"])) - weekday_ordinal(F.lit(s["first"])) + F.when(F.weekday(F.lit(s["last"])) < 5, 1).otherwise(0)).alias("n")).first()["n"]
        missing_days = largest["total"] or 0
        stats |= {"weekdays": expected, "missing": missing_days, "coverage_pct": round(100 * (expected - missing_days) / expected, 2) if expected else None}
        stats |= {c: (round(s[f"min_{c}"], 4), round(s[f"max_{c}"], 4)) for c in figures if s[f"min_{c}"] is not None}
        stats |= {c: (s[f"max_{c}"], s[f"mean_{c}"]) for c in lags}
    return Result(spark.createDataFrame(found, FINDINGS), stats)


def markdown(result: Result, title: str = "Daily table") -> str:
    """The result as a short document: figures, then errors, then warnings."""
    rows = result.rows()
    out = [f"# {title}: {'FAIL' if any(r['level'] == 'error' for r in rows) else 'PASS'}", "", "| figure | value |", "|---|---|"]
    out += [f"| {k} | {v} |" for k, v in result.stats.items()]
    for level in ("error", "warning"):
        found = [r for r in rows if r["level"] == level]
        out += ["", f"## {level.capitalize()}s ({len(found)})", *[f"- {r['check']}: {r['message']}" for r in found]]
    return "\n".join(out) + "\n"
