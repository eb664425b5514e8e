"""Alignment of series on one snapshot calendar, with a full report.

`day_table` is the core of a whole alignment: a row for each calendar day with every series' value, lag and own observation, from one
look-up of the observations. The daily table is its days with all required series; drops, carries, gaps and the report are
aggregations over it, so a report costs one pass, or none if it is observed while the table is written (`provenance.publish`). `aligned_long`
gives the same look-ups as a row for each day and series. Lags count from the snapshot day, for every convention. `carried_forward` counts
lookups older than the policy's own shift; `carried_over_one` counts lags over 1 under the shifted
convention and over 0 otherwise, as daily reports of such tables often do.

Defined results: an empty calendar gives empty tables; days on which a required series is missing are
dropped and logged with each series that is missing; optional series never drop a day.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import LAGS, OPTIONAL, REQUIRED, SPREADS, Config, check_series, policy, policy_rows, weekdays_of
from .asof import asof_lookup
from .calendars import closures_between, gap_reason, weekday_calendar


#: No weekday lies further back from the next one of a mask.
WEEK = dt.timedelta(days=7)


class Aligned:
    """One alignment: its days, and what is made of them when it is asked for."""

    def __init__(self, days: DataFrame, rules: Rules, observed: Observation | None = None) -> None:
        self.days, self.rules = days, rules
        #: Filled with the metrics once `daily` is read or written, if `align` was given one.
        self.observed = observed

    @cached_property
    def metrics(self) -> dict[str, Column]:
        """Aggregations over `days` that make up the report, by section|series|reason."""
        return self.rules.metrics()

    @cached_property
    def daily(self) -> DataFrame:
        """The daily table: series, spreads and the lag of each group, on days with all required series."""
        seen = self.days.observe(self.observed, *[c.alias(k) for k, c in self.metrics.items()]) if self.observed else self.days
        rows, series = self.rules.rows, [r[0] for r in self.rules.rows]
        lags = {n: [F.col(f"g_{r[0]}") for r in rows if r[1] == g and r[5]] for n, g in LAGS.items()}
        values = [F.col(f"v_{c}").alias(c) for c in series]
        longest = [(F.greatest(*own) if len(own) > 1 else own[0] if own else F.lit(None).cast("int")).alias(n) for n, own in lags.items()]
        spreads = {name: F.col(x) - F.col(y) for name, (x, y) in SPREADS.items()}
        return seen.filter(self.rules.kept).select("date", *values, *longest).withColumns(spreads).select("date", *REQUIRED, *SPREADS, *[c for c in OPTIONAL if c in series], *LAGS)

    @cached_property
    def drops(self) -> DataFrame:
        """(date, series, reason) of each required series that is missing on a day."""
        rows = _exploded([(F.lit(n).alias("series"), F.lit(r).alias("reason"), gone.alias("gone")) for n, r, gone in self.rules.dropped()])
        return self.days.select("date", rows).filter("_e.gone").select("date", "_e.series", "_e.reason")

    @cached_property
    def gaps(self) -> DataFrame:
        """(series, date, reason) of each day on which a series has no observation of its own."""
        rows = _exploded([(F.lit(r[0]).alias("series"), F.col(f"r_{r[0]}").alias("reason")) for r in self.rules.rows])
        return self.days.select("date", rows).filter("_e.reason is not null").select("_e.series", "date", "_e.reason")

    @cached_property
    def carries(self) -> DataFrame:
        """(series, carried_forward, carried_over_one, max_lag) over the days that are kept."""
        kinds = ("carried_forward", "carried_over_one", "max_lag")
        counted = self.days.agg(*[c.alias(f"{k}|{r[0]}") for r in self.rules.rows for k, c in self.rules.carried(r).items()])
        return counted.select(_exploded([(F.lit(r[0]).alias("series"), *[F.col(f"`{k}|{r[0]}`").alias(k) for k in kinds]) for r in self.rules.rows])).select("_e.*")


def _exploded(fields: list[tuple]) -> Column:
    return F.explode(F.array(*[F.struct(*f) for f in fields])).alias("_e")


def targets_of(rules: DataFrame, calendar: DataFrame) -> DataFrame:
    """The day that is looked up for each series and calendar day: their product is what an alignment gives.

    The calendar has a row for each day of the settings' range, so it may go to every task, however many series there are.
    """
    targets = rules.crossJoin(F.broadcast(calendar)).withColumn("back", F.when(F.col("shift") == "previous", F.col("back")).otherwise(F.lit(0)))
    return targets.withColumn("target", F.expr("date_sub(date, back)")).select("date", "series", "target", "grp", "required", "exact", "shift", "back")


def looked_up(targets: DataFrame, observations: DataFrame, rules: DataFrame, longest: int | None = None, between: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Targets with the observation that each may read."""
    found = asof_lookup(targets, observations, rules, longest, between)
    return found.withColumn("lag_days", F.datediff("date", "obs_date")).drop("target")


def aligned_long(observations: DataFrame, rules: DataFrame, calendar: DataFrame, longest: int | None = None, between: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """(date, series, grp, required, exact, shift, back, obs_date, value, lag_days) for each calendar day and series."""
    return looked_up(targets_of(rules, calendar), observations, rules, longest, between)


def drop_reason() -> Column:
    """Why a row of `aligned_long` drops its day; null where it does not."""
    return F.when(F.col("required") & F.col("value").isNull(), F.when(F.col("exact"), F.lit("missing_on_snapshot_date")).otherwise(F.lit("stale_beyond_max_lag")))


def drop_log(long: DataFrame) -> DataFrame:
    """(date, series, reason) of each required series that is missing on a day."""
    return long.filter("required and value is null").select("date", "series", drop_reason().alias("reason"))


def group_lags(long: DataFrame) -> DataFrame:
    """(date, grp, lag_days, n_values): the longest lag of each group's required series."""
    return long.groupBy("date", "grp").agg(F.max(F.when(F.col("required"), F.col("lag_days"))).alias("lag_days"), F.count("value").alias("n_values"))


def wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """The daily table: series, spreads and the lag of each group, on days with all required series."""
    # one aggregation in place of a pivot and joins: the columns are known
    at = lambda name: F.max(F.when(F.col("series") == name, F.col("value"))).alias(name)
    lag = lambda name, group: F.max(F.when((F.col("grp") == group) & F.col("required"), F.col("lag_days"))).alias(name)
    rows = long.groupBy("date").agg(*[at(c) for c in columns], *[lag(n, g) for n, g in LAGS.items()])
    rows = rows.dropna(subset=[c for c in columns if c in REQUIRED])
    for name, (a, b) in SPREADS.items():
        rows = rows.withColumn(name, F.col(a) - F.col(b))
    return rows.select("date", *REQUIRED, *SPREADS, *[c for c in OPTIONAL if c in columns], *LAGS)


def carries(long: DataFrame, daily: DataFrame) -> DataFrame:
    """(series, carried_forward, carried_over_one, max_lag) over the days that are kept; as-of series carry."""
    kept = long.join(daily.select("date"), "date", "left_semi")
    old, over = F.col("lag_days") > F.col("back"), F.col("lag_days") > F.when(F.col("shift") == "previous", 1).otherwise(0)
    return kept.groupBy("series").agg(F.count_if(~F.col("exact") & old).alias("carried_forward"), F.count_if(~F.col("exact") & over).alias("carried_over_one"), F.max("lag_days").alias("max_lag"))


class Rules:
    """What the columns of a day table mean under a policy (rows as `policy_rows` gives them)."""

    def __init__(self, rows: list[tuple], closed: dict[str, set[dt.date]], end: dt.date, publication_lag: int) -> None:
        self.rows, self.closed, self.end, self.late = rows, closed, end, publication_lag
        self.kept = F.expr(" and ".join([f"v_{r[0]} is not null" for r in rows if r[5]] or ["true"]))

    def dropped(self) -> list[tuple[str, str, Column]]:
        """(series, reason, whether it is missing on a day) of the required series."""
        return [(r[0], "missing_on_snapshot_date" if r[6] else "stale_beyond_max_lag", F.col(f"v_{r[0]}").isNull()) for r in self.rows if r[5]]

    def reasons(self, days: DataFrame) -> DataFrame:
        """days with r_*: why a day has no observation of its own, null where it has."""
        holiday = {m: F.expr("date in (" + ", ".join(f"date'{d}'" for d in sorted(found)) + ")") if found else F.lit(False) for m, found in self.closed.items()}
        reason = days.withColumns({f"_{m}": gap_reason(F.col("date"), shut, self.end, self.late) for m, shut in holiday.items()})
        return reason.withColumns({f"r_{r[0]}": F.expr(f"if(o_{r[0]}, null, _{r[2]})") for r in self.rows}).drop(*[f"_{m}" for m in holiday])

    def carried(self, row: tuple) -> dict[str, Column]:
        lag, shifted = f"g_{row[0]}", row[4] == "previous"
        count = lambda least: F.lit(0).cast("long") if row[6] else F.count_if(self.kept & F.expr(f"{lag} > {least}"))
        return {"carried_forward": count("back" if shifted else 0), "carried_over_one": count(int(shifted)), "max_lag": F.max(F.when(self.kept, F.col(lag)))}

    def metrics(self) -> dict[str, Column]:
        """Names as section|series|reason."""
        gone = ", ".join(f"if(v_{name} is null, named_struct('column', '{name}', 'reason', '{reason}'), null)" for name, reason, _ in self.dropped())
        day = F.expr(f"named_struct('date', date, 'missing', array_compact(array({gone})))")
        out = {"rows_out": F.count_if(self.kept), "rows_dropped": F.count_if(~self.kept), "first": F.min(F.when(self.kept, F.col("date"))), "last": F.max(F.when(self.kept, F.col("date")))}
        out |= {f"dropped|{name}|{reason}": F.expr(f"count_if(v_{name} is null)") for name, reason, _ in self.dropped()}
        for row in self.rows:
            out |= {f"gaps|{row[0]}|{reason}": F.expr(f"count_if(r_{row[0]} = '{reason}')") for reason in ("holiday", "publication_lag", "unexplained")}
            out |= {f"{k}|{row[0]}": c for k, c in self.carried(row).items()}
            out[f"dates|{row[0]}"] = F.expr(f"array_sort(collect_list(if(r_{row[0]} = 'unexplained', cast(date as string), null)))")
        out["dropped_dates"] = F.array_sort(F.collect_list(F.when(~self.kept, day)))
        return out


def day_table(observations: DataFrame, rules: DataFrame, calendar: DataFrame, series: list[str], longest: int | None = None, between: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """(date, back, v_*, g_*, o_*): for each calendar day, and each series, the value looked up, its lag, and whether the day has an observation of its own.

    A series that is read on another day asks twice, for the day that is read and for its own; all else asks once.
    """
    asked = rules.crossJoin(F.broadcast(calendar)).withColumn("read", F.expr("if(shift = 'previous', date_sub(date, back), date)"))
    roles = F.expr("if(read = date, array(named_struct('target', read, 'reads', true)), array(named_struct('target', read, 'reads', true), named_struct('target', date, 'reads', false)))")
    targets = asked.select("date", "series", "back", F.explode(roles).alias("r")).select("date", "series", "back", "r.target", "r.reads")
    found = asof_lookup(targets, observations, rules, longest, between)
    columns = []
    for name in series:
        columns += [F.expr(f"max(if(series = '{name}' and reads, value, null)) as v_{name}"), F.expr(f"max(if(series = '{name}' and reads, datediff(date, obs_date), null)) as g_{name}")]
        columns += [F.expr(f"coalesce(max(series = '{name}' and target = date and obs_date = date), false) as o_{name}")]
    return found.groupBy("date").agg(F.max("back").alias("back"), *columns)


def align(spark: SparkSession, observations: DataFrame, config: Config, series: list[str], observed: Observation | None = None) -> Aligned:
    check_series(set(series))
    start, end = config.project.start_date, config.project.end
    table = policy(spark, config.alignment, series)
    calendar = weekday_calendar(spark, start, end, weekdays_of(config.alignment.weekmask))
    rules = Rules(policy_rows(config.alignment, series), {m: closures_between(m, start, end) for m in ("us", "jp")}, end, config.alignment.publication_lag_days)
    days = day_table(observations, table, calendar, series, max(config.alignment.asof_max_lag_days.values(), default=0), (start - WEEK, end))
    return Aligned(rules.reasons(days), rules, observed)


def dropped_dates(drops: DataFrame) -> DataFrame:
    """(date, columns, reasons): the series and the distinct reasons of each dropped day, in order (K3)."""
    return drops.groupBy("date").agg(F.array_sort(F.collect_list("series")).alias("columns"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def report_of(found: dict) -> dict:
    """The roll-up (E11) of the figures that `metrics` name."""
    parts = lambda section: {tuple(k.split("|")[1:]): v for k, v in found.items() if k.startswith(f"{section}|")}
    counts = lambda section: dict(sorted(("/".join(k), v) for k, v in parts(section).items() if v))
    kinds = {k: parts(k) for k in ("carried_forward", "carried_over_one", "max_lag")}
    return {
        "rows_out": found["rows_out"],
        "rows_dropped": found["rows_dropped"],
        "dropped_by_reason": counts("dropped"),
        "carries": {name: {k: v[name,] for k, v in kinds.items()} for (name,) in sorted(kinds["max_lag"])},
        "gaps": counts("gaps"),
        "unexplained": {name: list(dates) for (name,), dates in sorted(parts("dates").items()) if dates},
    }


def report(aligned: Aligned) -> dict:
    """The roll-up of an alignment (E11), by one aggregation over its days."""
    return report_of(aligned.days.agg(*[c.alias(k) for k, c in aligned.metrics.items()]).first().asDict())


def report_rows(aligned: Aligned) -> DataFrame:
    """The roll-up as a table (section, key, n), for reports that are kept and compared; counts of nothing have no row but for rows and carries."""
    wanted = {k: c for k, c in aligned.metrics.items() if k in ("rows_out", "rows_dropped") or "|" in k and not k.startswith("dates|")}
    totals = aligned.days.agg(*[c.alias(k) for k, c in wanted.items()])
    parts = [(k, *k.split("|", 1)) if "|" in k else (k, k, "") for k in wanted]
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(key.replace("|", "/")).alias("key"), F.col(f"`{k}`").cast("long").alias("n")) for k, section, key in parts])
    out = totals.select(F.explode(rows).alias("r")).select("r.*")
    return out.filter(~F.col("section").isin("dropped", "gaps") | (F.col("n") > 0))


def at_date(daily: DataFrame, date: dt.date) -> DataFrame:
    return daily.filter(F.col("date") == date)
