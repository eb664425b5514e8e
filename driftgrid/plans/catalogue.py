"""Queries over the driver's tables, one or more for each operator, with equal DuckDB SQL.

`events` stands for feeds (a series is a user, sparse days), daily `orders` for long series, one for each priority. Readers
read files that the query writes from these tables first, in the folder of `landing.scratch`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, parse
from ..functions import filters, ledger, rolling, significance, stats, sweeps, trading
from ..functions import series as models
from ..operators import align, asof, calendars, dedup, provenance, validate
from ..sources import feeds, landing
from ..streaming import signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 30)

#: SQL that several oracles begin with.
CLOSES = """closes AS (SELECT user_id, CAST(ts AS DATE) AS obs_date, arg_max(value, (ts, event_id)) AS value
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"""
CALENDAR = """cal AS (SELECT CAST(d AS DATE) AS date, CASE WHEN isodow(d) = 1 THEN 3 ELSE 1 END AS back
  FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6)"""
USERS = "users AS (SELECT DISTINCT user_id FROM events)"
DAILY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS price, count(*) AS n,
  round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top FROM orders GROUP BY 1)"""
#: One long series for each priority.
PRICES = """prices AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS price, count(*) AS n,
  round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2)"""
US_DAYS = "us(date) AS (VALUES (DATE '2024-01-01'), (DATE '2024-01-15'))"
JP_DAYS = "jp(date) AS (VALUES (DATE '2024-01-01'), (DATE '2024-01-02'), (DATE '2024-01-03'), (DATE '2024-01-08'))"


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of events as observations."""
    events = _read(spark, sf_dir, "events").filter("value is not null and ts is not null")
    day = events.select(F.col("user_id").alias("series"), F.to_date("ts").alias("obs_date"), "value", "ts", "event_id")
    return dedup.keep_last(day, ["series", "obs_date"], ["ts", "event_id"]).select("series", "obs_date", "value")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("series")).filter("series is not null").distinct()


def _rules(spark: SparkSession, sf_dir: str, max_lag: int, shift: str = "none") -> DataFrame:
    exact = max_lag == 0
    return _users(spark, sf_dir).select("series", F.pmod("series", F.lit(3)).cast("string").alias("grp"), F.when(F.col("series") % 2 == 0, "us").otherwise("jp").alias("market"), F.lit(max_lag).alias("max_lag"), F.lit(shift).alias("shift"), (F.col("series") % 5 != 0).alias("required"), F.lit(exact).alias("exact"))


def _calendar(spark: SparkSession) -> DataFrame:
    return calendars.weekday_calendar(spark, START, END)


def _long(spark: SparkSession, sf_dir: str, max_lag: int, shift: str) -> DataFrame:
    return align.aligned_long(_closes(spark, sf_dir), _rules(spark, sf_dir, max_lag, shift), _calendar(spark), max_lag, (START - align.WEEK, END))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("top"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def _long_sql(max_lag: int, back: str) -> str:
    """The as-of join of closes on users and days, in DuckDB's own as-of form."""
    return f"""WITH {CLOSES}, {CALENDAR}, {USERS},
t AS (SELECT u.user_id, cal.date, {back} AS back, CAST(cal.date - {back} AS DATE) AS target FROM cal CROSS JOIN users u),
a AS (SELECT t.*, c.obs_date AS o, c.value AS v FROM t ASOF LEFT JOIN closes c ON t.user_id = c.user_id AND t.target >= c.obs_date),
long AS (SELECT user_id, date, back, CASE WHEN target - o <= {max_lag} THEN v END AS value,
  CASE WHEN target - o <= {max_lag} THEN CAST(date - o AS INTEGER) END AS lag_days, user_id % 5 <> 0 AS required, CAST(user_id % 3 AS VARCHAR) AS grp FROM a)
"""


@query(f"WITH {CLOSES} SELECT * FROM closes")
def daily_close(spark, sf_dir):
    return _closes(spark, sf_dir).withColumnRenamed("series", "user_id")


@query(_long_sql(2, "0") + "SELECT user_id, date, value, lag_days FROM long")
def asof_tolerance(spark, sf_dir):
    """Flagship: each user's close on each weekday, at most two days old."""
    return _long(spark, sf_dir, 2, "none").select(F.col("series").alias("user_id"), "date", "value", "lag_days")


@query(_long_sql(0, "0") + "SELECT user_id, date, value FROM long")
def exact_lookup(spark, sf_dir):
    return _long(spark, sf_dir, 0, "none").select(F.col("series").alias("user_id"), "date", "value")


@query(_long_sql(10000, "0") + "SELECT user_id, date, value, lag_days FROM long")
def asof_unbounded(spark, sf_dir):
    targets = _calendar(spark).select(F.col("date").alias("target")).crossJoin(_users(spark, sf_dir))
    found = asof.asof_unbounded(targets, _closes(spark, sf_dir))
    return found.select(F.col("series").alias("user_id"), F.col("target").alias("date"), "value", F.datediff("target", "obs_date").alias("lag_days"))


@query("""SELECT CAST(o_orderdate AS DATE) AS date, any_value(CASE WHEN isodow(o_orderdate) = 1 THEN 3 ELSE 1 END)::INTEGER AS back, any_value(CAST(o_orderdate AS DATE) - CASE WHEN isodow(o_orderdate) = 1 THEN 3 ELSE 1 END)::DATE AS before, count(*) AS n_orders
FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY CAST(o_orderdate AS DATE)""")
def prev_weekday_shift(spark, sf_dir):
    """The weekday before each weekday on which something was ordered."""
    days = _read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n_orders"))
    calendar = calendars.weekday_calendar(spark, dt.date(1990, 1, 1), dt.date(2030, 12, 31))
    return days.join(calendar, "date").select("date", "back", F.expr("date_sub(date, back)").alias("before"), "n_orders")


@query(_long_sql(3, "back") + "SELECT user_id, date, value, lag_days, CASE WHEN required AND value IS NULL THEN 'stale_beyond_max_lag' END AS drop_reason FROM long")
def aligned_shifted(spark, sf_dir):
    return _long(spark, sf_dir, 3, "previous").select(F.col("series").alias("user_id"), "date", "value", "lag_days", align.drop_reason().alias("drop_reason"))


@query(_long_sql(3, "back") + "SELECT date, user_id, 'stale_beyond_max_lag' AS reason FROM long WHERE required AND value IS NULL")
def drop_log(spark, sf_dir):
    return align.drop_log(_long(spark, sf_dir, 3, "previous")).withColumnRenamed("series", "user_id")


@query(_long_sql(0, "0") + "SELECT date, count(*) AS n, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users, 'missing_on_snapshot_date' AS reasons FROM long WHERE required AND value IS NULL GROUP BY date")
def drop_reasons(spark, sf_dir):
    found = align.dropped_dates(align.drop_log(_long(spark, sf_dir, 0, "none")))
    return found.select("date", F.size("columns").cast("long").alias("n"), F.array_join(F.col("columns").cast("array<string>"), ",").alias("users"), F.array_join("reasons", ",").alias("reasons"))


@query(_long_sql(3, "back") + """SELECT user_id, count(*) FILTER (lag_days > back) AS carried_forward, count(*) FILTER (lag_days > 1) AS carried_over_one, max(lag_days) AS max_lag
FROM long GROUP BY user_id""")
def carried_counts(spark, sf_dir):
    long = _long(spark, sf_dir, 3, "previous")
    return align.carries(long, _calendar(spark)).withColumnRenamed("series", "user_id")


@query(_long_sql(2, "0") + "SELECT user_id, max(lag_days) AS max_lag FROM long WHERE lag_days IS NOT NULL GROUP BY user_id")
def max_lag(spark, sf_dir):
    return _long(spark, sf_dir, 2, "none").filter("lag_days is not null").groupBy(F.col("series").alias("user_id")).agg(F.max("lag_days").alias("max_lag"))


@query(_long_sql(2, "0") + "SELECT date, grp, max(lag_days) FILTER (required) AS lag_days, count(value) AS n_values FROM long GROUP BY date, grp")
def group_lag(spark, sf_dir):
    return align.group_lags(_long(spark, sf_dir, 2, "none"))


@query("""SELECT CAST(ts AS DATE) AS date, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view_,
round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1""")
def pivot_wide(spark, sf_dir):
    events = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"))
    total = lambda kind, name: F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), 4).alias(name)
    return events.agg(total("click", "click"), total("view", "view_"), total("purchase", "purchase"))


@query("""WITH f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice, o_orderkey, 0 AS p FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), -o_totalprice, o_orderkey, 1 FROM orders WHERE o_orderkey % 3 <> 1)
SELECT o_custkey AS series, d AS obs_date, arg_max(o_totalprice, (p, o_orderkey)) AS value FROM f GROUP BY ALL""")
def priority_merge(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.to_date("o_orderdate").alias("obs_date"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ordinal"))
    later = rows.filter("ordinal % 3 <> 1").withColumn("value", -F.col("value"))
    return dedup.priority_merge([rows.filter("ordinal % 3 <> 0"), later], ["series", "obs_date"], ["ordinal"]).drop("ordinal")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def keep_last_dedup(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return dedup.keep_last(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6),
g AS (SELECT lag(date) OVER (ORDER BY date) AS before, date FROM d),
n AS (SELECT before, date, (SELECT count(*) FROM generate_series(before + 1, date - 1, INTERVAL 1 DAY) s(x) WHERE isodow(x) < 6) AS n FROM g WHERE before IS NOT NULL)
SELECT * FROM n WHERE n > 0""")
def date_gaps(spark, sf_dir):
    return validate.gaps(_daily(spark, sf_dir))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) < 6),
g AS (SELECT user_id, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS before, date FROM d),
n AS (SELECT *, (SELECT count(*) FROM generate_series(before + 1, date - 1, INTERVAL 1 DAY) s(x) WHERE isodow(x) < 6) AS weekdays_between FROM g WHERE before IS NOT NULL)
SELECT * FROM n WHERE weekdays_between > 0""")
def series_gaps(spark, sf_dir):
    days = _read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date")).filter(F.weekday("date") < 5)
    return calendars.date_gaps(days, ["user_id"])


@query(f"""WITH {CLOSES}, {CALENDAR}, {USERS}, {US_DAYS}, {JP_DAYS},
m AS (SELECT u.user_id, cal.date FROM cal CROSS JOIN users u ANTI JOIN closes c ON u.user_id = c.user_id AND cal.date = c.obs_date)
SELECT m.user_id, m.date, CASE WHEN m.user_id % 2 = 0 AND us.date IS NOT NULL OR m.user_id % 2 <> 0 AND jp.date IS NOT NULL THEN 'holiday'
  WHEN m.date > DATE '2024-01-27' THEN 'publication_lag' ELSE 'unexplained' END AS reason
FROM m LEFT JOIN us ON m.date = us.date LEFT JOIN jp ON m.date = jp.date""")
def gap_classification(spark, sf_dir):
    series = _rules(spark, sf_dir, 0)
    return calendars.classify_gaps(_closes(spark, sf_dir), series, _calendar(spark), calendars.holidays(spark, START, END), END, 3).withColumnRenamed("series", "user_id")


CLOSED = {
    "us": ["01-01", "01-15", "02-19", "03-29", "05-27", "06-19", "07-04", "09-02", "10-14", "11-11", "11-28", "12-25"],
    "jp": ["01-01", "01-02", "01-03", "01-08", "02-11", "02-12", "02-23", "03-20", "04-29", "05-03", "05-04", "05-05", "05-06", "07-15", "08-11", "08-12", "09-16", "09-22", "09-23", "10-14", "11-03", "11-04", "11-23", "12-31"],
}


@query("""SELECT market, CAST('2024-' || day AS DATE) AS date, count(event_id) AS n_events FROM (VALUES """ + ", ".join(f"('{m}', '{d}')" for m, days in CLOSED.items() for d in days) + """) AS c(market, day)
LEFT JOIN events ON CAST(ts AS DATE) = CAST('2024-' || day AS DATE) GROUP BY ALL""")
def holiday_table(spark, sf_dir):
    """The rules against the published closures of a whole year, and the events on each of them."""
    closed = calendars.holidays(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).select("market", "date")
    days = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("event_id").alias("n_events"))
    return closed.join(days, "date", "left").select("market", "date", F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def ordered_list_agg(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT event_type AS series, count(*) AS n_rows, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events WHERE value IS NOT NULL GROUP BY 1")
def source_ranges(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("obs_date"), "value")
    return provenance.source_ranges(rows)


@query(f"""WITH {PRICES}, w AS (SELECT series, date, count(*) OVER p AS k, regr_slope(price, mean) OVER p AS s, regr_intercept(price, mean) OVER p AS i FROM prices
WINDOW p AS (PARTITION BY series ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT series, date, CASE WHEN k = 60 AND NOT isnan(s) THEN round(s, 6) END AS slope, CASE WHEN k = 60 AND NOT isnan(i) THEN round(i, 2) END AS intercept FROM w""")
def rolling_ols(spark, sf_dir):
    found = stats.rolling_ols(_prices(spark, sf_dir), "price", "mean", ["series"], ["date"], 60)
    return found.select("series", "date", F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"))


ZSCORES = f"""{PRICES}, zw AS (SELECT series, date, mean, count(*) OVER p AS k, avg(mean) OVER p AS m, stddev_samp(mean) OVER p AS s FROM prices
WINDOW p AS (PARTITION BY series ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
zscores AS (SELECT series, date, CASE WHEN k = 60 THEN round((mean - m) / nullif(s, 0), 5) END AS z FROM zw)"""


@query(f"WITH {ZSCORES} SELECT * FROM zscores")
def rolling_zscore(spark, sf_dir):
    return stats.rolling_zscore(_prices(spark, sf_dir), "mean", ["series"], ["date"], 60).select("series", "date", F.round("z", 5).alias("z"))


@query(f"""WITH {PRICES}, s AS (SELECT series, lag(mean) OVER w AS x, mean - lag(mean) OVER w AS y FROM prices WINDOW w AS (PARTITION BY series ORDER BY date))
SELECT series, round(regr_slope(y, x), 8) AS kappa, round(-ln(2) / regr_slope(y, x), 6) AS half_life, regr_count(y, x)::BIGINT AS n FROM s GROUP BY series""")
def half_life(spark, sf_dir):
    found = stats.half_life(_prices(spark, sf_dir), "mean", ["series"], ["date"])
    return found.select("series", F.round("kappa", 8).alias("kappa"), F.round("half_life", 6).alias("half_life"), "n")


@query(None)
def half_life_interval(spark, sf_dir):
    """Seeded resamples; held in the tests against the half-life of the whole series and of resamples drawn by a plain loop."""
    return models.half_life_interval(_prices(spark, sf_dir), "mean", ["series"], ["date"])


@query(f"""WITH {PRICES}, r AS (SELECT series, count(*) AS n, regr_syy(price, n) - regr_sxy(price, n) ** 2 / regr_sxx(price, n) AS a,
  regr_syy(price, n) FILTER (date < DATE '1998-01-01') - regr_sxy(price, n) FILTER (date < DATE '1998-01-01') ** 2 / regr_sxx(price, n) FILTER (date < DATE '1998-01-01') AS b,
  regr_syy(price, n) FILTER (date >= DATE '1998-01-01') - regr_sxy(price, n) FILTER (date >= DATE '1998-01-01') ** 2 / regr_sxx(price, n) FILTER (date >= DATE '1998-01-01') AS c FROM prices GROUP BY series)
SELECT series, n, round(((a - b - c) / 2) / ((b + c) / (n - 4)), 5) AS f FROM r""")
def chow_test(spark, sf_dir):
    found = stats.chow(_prices(spark, sf_dir), "price", "n", "date", dt.date(1998, 1, 1), ["series"])
    return found.select("series", "n", F.round("f", 5).alias("f"))


@query(f"""WITH {PRICES}, f AS (SELECT series, regr_slope(price, n) AS slope, regr_intercept(price, n) AS intercept FROM prices GROUP BY series)
SELECT series, date, round(f.intercept + f.slope * p.n, 2) AS fair, round(p.price - f.intercept - f.slope * p.n, 2) AS residual FROM prices p JOIN f USING (series)""")
def fair_value(spark, sf_dir):
    prices = _prices(spark, sf_dir)
    fits = stats.fit(prices, "price", "n", ["series"]).select("series", "slope", "intercept")
    return stats.residual(prices.join(fits, "series"), "price", "n").select("series", "date", F.round("fair", 2).alias("fair"), F.round("residual", 2).alias("residual"))


@query(f"""WITH {PRICES}, r AS (SELECT *, year(date) AS block FROM prices),
b AS (SELECT series, block, (SELECT regr_slope(price, mean) FROM r q WHERE q.series = r.series AND q.block < r.block) AS slope,
  (SELECT regr_intercept(price, mean) FROM r q WHERE q.series = r.series AND q.block < r.block) AS intercept FROM (SELECT DISTINCT series, block FROM r) r)
SELECT series, date, round(slope, 6) AS slope, round(price - intercept - slope * mean, 2) AS residual FROM r JOIN b USING (series, block)""")
def walk_forward(spark, sf_dir):
    found = stats.walk_forward(_prices(spark, sf_dir).withColumn("block", F.year("date")), "price", "mean", ["series"], "block")
    return found.select("series", "date", F.round("slope", 6).alias("slope"), F.round("residual", 2).alias("residual"))


@query(f"""WITH {PRICES}, v AS (SELECT series, date, mean - 150000 AS v FROM prices), a(anchor, f, t, sign) AS (VALUES ('low', DATE '1996-01-01', DATE '1996-01-31', -1), ('high', DATE '1997-07-01', DATE '1997-07-31', 1))
SELECT series, anchor, count(v) AS n, round(avg(v), 3) AS mean, sign(avg(v)) = any_value(sign) AS ok
FROM (SELECT DISTINCT series FROM v) CROSS JOIN a LEFT JOIN v USING (series) WHERE date BETWEEN f AND t GROUP BY series, anchor""")
def anchor_checks(spark, sf_dir):
    rows = _prices(spark, sf_dir).withColumn("v", F.col("mean") - 150000)
    spans = [("low", dt.date(1996, 1, 1), dt.date(1996, 1, 31), -1), ("high", dt.date(1997, 7, 1), dt.date(1997, 7, 31), 1)]
    found = stats.anchor_checks(rows, "v", "date", ["series"], spans)
    return found.filter("n > 0").select("series", "anchor", "n", F.round("mean", 3).alias("mean"), "ok")


@query("SELECT o_orderpriority AS series, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept, regr_count(o_totalprice, o_custkey)::BIGINT AS n FROM orders GROUP BY 1")
def static_ols(spark, sf_dir):
    found = stats.fit(_read(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])
    return found.select(F.col("o_orderpriority").alias("series"), F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


#: A daily table with defects of every kind: its days, and the rows of the 4th of each month twice.
DEFECTS = f"""{DAILY}, base AS (SELECT date, n, day(date) AS d, round(mean / 50000, 4) AS m FROM daily WHERE isodow(date) < 6 AND day(date) NOT BETWEEN 10 AND 20),
rows_ AS (SELECT date, 100.0 + n AS usdjpy, m AS us2y, m + 0.5 AS us10y, CASE WHEN d <> 1 THEN 0.1 END AS jgb2y, 0.25 AS jgb10y, CASE WHEN d <> 1 THEN m - 0.1 END AS spread2y,
  m + 0.25 + CASE WHEN d = 5 THEN 0.5 ELSE 0 END AS spread10y, CASE WHEN d <> 2 THEN 1.0 END AS us10y_real, 0 AS fx_lag_days, CASE WHEN d = 3 THEN -1 ELSE 0 END AS us_lag_days, d % 3 AS jgb_lag_days, d FROM base),
t AS (SELECT * FROM rows_ UNION ALL SELECT * FROM rows_ WHERE d = 4),
g AS (SELECT lag(date) OVER (ORDER BY date) AS before, date FROM (SELECT DISTINCT date FROM t)),
gaps AS (SELECT before, date, (SELECT count(*) FROM generate_series(before + 1, date - 1, INTERVAL 1 DAY) s(x) WHERE isodow(x) < 6) AS n FROM g WHERE before IS NOT NULL)"""


def _defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.dayofmonth("date")
    base = _daily(spark, sf_dir).filter((F.weekday("date") < 5) & ~d.between(10, 20)).withColumns({"d": d, "m": F.round(F.col("mean") / 50000, 4)})
    values = {
        "usdjpy": F.col("n") + 100.0, "us2y": F.col("m"), "us10y": F.col("m") + 0.5, "jgb2y": F.when(F.col("d") != 1, 0.1), "jgb10y": F.lit(0.25), "spread2y": F.when(F.col("d") != 1, F.col("m") - 0.1),
        "spread10y": F.col("m") + 0.25 + F.when(F.col("d") == 5, 0.5).otherwise(0), "us10y_real": F.when(F.col("d") != 2, 1.0), "fx_lag_days": F.lit(0), "us_lag_days": F.when(F.col("d") == 3, -1).otherwise(0), "jgb_lag_days": F.col("d") % 3,
    }
    rows = base.select("date", *[c.alias(n) for n, c in values.items()], "d")
    return rows.unionByName(rows.filter("d = 4")).drop("d")


def _checked(spark: SparkSession, sf_dir: str) -> validate.Result:
    rules = {"bounds": {"usdjpy": [101.5, 106], "jgb10y": [0, 1]}, "required_start_before": "1990-01-01", "min_rows": 10**7, "max_gap_business_days": 5, "max_days_stale_end": 10}
    table = _defective(spark, sf_dir).withColumn("note", F.lit("x"))
    return validate.validate(table, _config("ny_close", "1990-01-01", "2024-12-31", rules), {"row_count": 1, "convention": "tokyo_close"})


@query(f"""WITH {DEFECTS}, big AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM gaps WHERE n > 5), c AS (SELECT count(*) AS n, max(date) AS last FROM t)
SELECT 'warning' AS level, 'schema' AS "check", 'note' AS subject, 1::BIGINT AS n UNION ALL SELECT 'error', 'dates', 'date', count(*) FROM (SELECT date FROM t GROUP BY date HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'error', 'rows', 'table', n FROM c UNION ALL SELECT 'error', 'coverage', 'start', 1 UNION ALL SELECT 'error', 'coverage', 'end', datediff('day', last, DATE '2024-12-31') FROM c
UNION ALL SELECT 'error', 'nan', 'jgb2y', count(*) FROM t WHERE jgb2y IS NULL HAVING count(*) > 0 UNION ALL SELECT 'error', 'nan', 'spread2y', count(*) FROM t WHERE spread2y IS NULL HAVING count(*) > 0
UNION ALL SELECT 'warning', 'nan', 'us10y_real', count(*) FROM t WHERE us10y_real IS NULL HAVING count(*) > 0
UNION ALL SELECT 'error', 'bounds', 'usdjpy', count(*) FROM t WHERE usdjpy < 101.5 OR usdjpy > 106 HAVING count(*) > 0 UNION ALL SELECT 'error', 'consistency', 'spread10y', count(*) FROM t WHERE d = 5 HAVING count(*) > 0
UNION ALL SELECT 'error', 'lags', 'us_lag_days', count(*) FROM t WHERE us_lag_days < 0 HAVING count(*) > 0
UNION ALL SELECT 'error', 'gaps', CAST(date AS VARCHAR), n FROM big WHERE i <= 20 UNION ALL SELECT 'error', 'gaps', 'more', count(*) - 20 FROM big HAVING count(*) > 20
UNION ALL SELECT 'error', 'metadata', 'row_count', 1 UNION ALL SELECT 'warning', 'metadata', 'convention', 1""")
def validation_findings(spark, sf_dir):
    """All checks of `validate` at once on a table with every defect."""
    return _checked(spark, sf_dir).findings.select("level", "check", "subject", "n")


@query(f"""WITH {DEFECTS}, c AS (SELECT count(*) AS n, min(date) AS f, max(date) AS l, count(DISTINCT date) AS days FROM t),
e AS (SELECT (SELECT count(*) FROM generate_series(f, l, INTERVAL 1 DAY) s(x) WHERE isodow(x) < 6) AS w, days FROM c)
SELECT 'rows' AS figure, n::DOUBLE AS low, NULL::DOUBLE AS high FROM c UNION ALL SELECT 'largest_gap', max(n)::DOUBLE, NULL FROM gaps UNION ALL SELECT 'weekdays', w::DOUBLE, NULL FROM e
UNION ALL SELECT 'missing', (w - days)::DOUBLE, NULL FROM e UNION ALL SELECT 'coverage_pct', round(100 * days / w, 2), NULL FROM e
UNION ALL SELECT 'span', datediff('day', DATE '1970-01-01', f)::DOUBLE, datediff('day', DATE '1970-01-01', l)::DOUBLE FROM c
UNION ALL SELECT 'usdjpy', min(usdjpy), max(usdjpy) FROM t UNION ALL SELECT 'us2y', round(min(us2y), 4), round(max(us2y), 4) FROM t UNION ALL SELECT 'us10y', round(min(us10y), 4), round(max(us10y), 4) FROM t
UNION ALL SELECT 'jgb2y', min(jgb2y), max(jgb2y) FROM t UNION ALL SELECT 'jgb10y', min(jgb10y), max(jgb10y) FROM t UNION ALL SELECT 'spread2y', round(min(spread2y), 4), round(max(spread2y), 4) FROM t
UNION ALL SELECT 'spread10y', round(min(spread10y), 4), round(max(spread10y), 4) FROM t
UNION ALL SELECT 'fx_lag_days', max(fx_lag_days)::DOUBLE, round(avg(fx_lag_days), 3) FROM t UNION ALL SELECT 'us_lag_days', max(us_lag_days)::DOUBLE, round(avg(us_lag_days), 3) FROM t
UNION ALL SELECT 'jgb_lag_days', max(jgb_lag_days)::DOUBLE, round(avg(jgb_lag_days), 3) FROM t""")
def validation_figures(spark, sf_dir):
    """The figures of `validate`: ranges of values, and for lags the most and the mean."""
    found, epoch = dict(_checked(spark, sf_dir).stats), dt.date(1970, 1, 1)
    found["span"] = ((found.pop("first") - epoch).days, (found.pop("last") - epoch).days)
    pairs = {k: v if isinstance(v, tuple) else (v, None) for k, v in found.items()}
    return spark.createDataFrame([(k, *(None if x is None else float(x) for x in v)) for k, v in pairs.items()], "figure string, low double, high double")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, lag(CAST(o_orderdate AS DATE)) OVER (ORDER BY o_orderkey) AS b FROM orders) SELECT o_orderkey, date FROM o WHERE date < b""")
def unsorted_rows(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return validate.unsorted_rows(rows, "o_orderkey", stretch=1000)


@query("SELECT l_returnflag, count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS n, min(l_orderkey) FILTER (l_quantity < 5 OR l_quantity > 45) AS first_key FROM lineitem GROUP BY 1")
def bounds_violations(spark, sf_dir):
    bad = validate.outside("l_quantity", 5, 45)
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(bad).alias("n"), F.min(F.when(bad, F.col("l_orderkey"))).alias("first_key"))


@query("SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_dates(spark, sf_dir):
    return validate.duplicate_dates(_read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")))


@query(_long_sql(0, "0") + "SELECT date, count(*) - count(value) AS n_null FROM long GROUP BY date")
def null_counts(spark, sf_dir):
    return _long(spark, sf_dir, 0, "none").groupBy("date").agg(F.count_if(F.col("value").isNull()).alias("n_null"))


@query("SELECT count(*) AS n FROM lineitem WHERE NOT abs(l_extendedprice * (1 - l_discount) - l_extendedprice * 0.95) <= 1e-9 + 1e-5 * abs(l_extendedprice * 0.95)")
def consistency_check(spark, sf_dir):
    stored = F.col("l_extendedprice") * 0.95
    return _read(spark, sf_dir, "lineitem").agg(F.count_if(validate.differs(F.col("l_extendedprice") * (1 - F.col("l_discount")), stored)).alias("n"))


@query(None)
def raw_provenance(spark, sf_dir):
    """Hashes of whole files; held in the tests against hashlib."""
    return feeds.raw_files(spark, f"{sf_dir}/*.parquet", "table").select("source", F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "bytes")


#: The fold of positions row by row.
STATES = f"""WITH RECURSIVE {ZSCORES}, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM zscores),
f AS (SELECT series, 0::BIGINT AS k, 0 AS position, 0 AS held, false AS barred, NULL::VARCHAR AS reason, NULL::DATE AS date, NULL::DOUBLE AS z FROM (SELECT DISTINCT series FROM i)
UNION ALL SELECT series, k, CASE WHEN p <> 0 THEN CASE WHEN reason IS NULL THEN p ELSE 0 END WHEN reason = 'enter' THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END,
  CASE WHEN p <> 0 THEN held + 1 ELSE 0 END, coalesce(reason = 'stop', false) OR barred AND NOT coalesce(abs(z) <= 0.25, false), reason, date, z
FROM (SELECT i.series, i.k, f.position AS p, f.held, f.barred, i.date, i.z, CASE WHEN f.position <> 0 THEN CASE WHEN abs(i.z) >= 3.5 THEN 'stop' WHEN abs(i.z) <= 0.25 THEN 'exit' WHEN f.held + 1 >= 60 THEN 'time' END
  WHEN abs(i.z) >= 2 AND abs(i.z) < 3.5 AND NOT f.barred THEN 'enter' END AS reason FROM f JOIN i ON i.series = f.series AND i.k = f.k + 1)),
states AS (SELECT series, date, z, position, reason FROM f WHERE k > 0)
"""


def _states(spark, sf_dir):
    return trading.signal_states(rolling_zscore(spark, sf_dir), "z", ["series"], ["date"])


@query(STATES + "SELECT * FROM states")
def signal_state_fold(spark, sf_dir):
    return _states(spark, sf_dir)


RETURNS = STATES.rstrip() + """, h AS (SELECT s.series, s.date, s.position, p.mean, p.n, lag(s.position, 1, 0) OVER w AS held, lag(p.mean) OVER w AS before, lag(p.n) OVER w AS carry FROM states s JOIN prices p USING (series, date) WINDOW w AS (PARTITION BY s.series ORDER BY s.date)),
r AS (SELECT series, date, held * (mean / before - 1) AS spot, held * coalesce(carry, 0) / 100 / 252 AS carry_return, abs(held - lag(held, 1, 0) OVER (PARTITION BY series ORDER BY date)) * 2.0 / 1e4 AS cost FROM h),
v AS (SELECT *, spot + carry_return - cost AS value FROM r)
"""


def _returns(spark, sf_dir):
    rows = _states(spark, sf_dir).join(_prices(spark, sf_dir), ["series", "date"])
    return trading.backtest(rows, "position", "mean", ["series"], ["date"], carry="n", cost_bps=2.0)


@query(RETURNS + "SELECT series, date, round(spot, 6) AS spot, round(carry_return, 8) AS carry_return, cost, round(value, 6) AS value FROM v")
def backtest(spark, sf_dir):
    return _returns(spark, sf_dir).select("series", "date", F.round("spot", 6).alias("spot"), F.round("carry_return", 8).alias("carry_return"), "cost", F.round("value", 6).alias("value"))


@query(RETURNS.rstrip() + """, e AS (SELECT *, sum(value) OVER (PARTITION BY series ORDER BY date) AS equity FROM v), m AS (SELECT *, equity - greatest(max(equity) OVER (PARTITION BY series ORDER BY date), 0) AS down FROM e)
SELECT series, count(value) AS n, round(avg(value), 8) AS mean, round(avg(value) / nullif(stddev_samp(value), 0) * sqrt(252), 5) AS sharpe, round(avg(value) / nullif(sqrt(avg(least(value, 0) ** 2)), 0) * sqrt(252), 5) AS sortino,
round(exp(avg(ln(1 + value) ) FILTER (value > -1) * 252) - 1, 6) AS growth, round(min(down), 6) AS max_drawdown, round(count(*) FILTER (value > 0) / nullif(count(*) FILTER (value <> 0), 0), 6) AS hit_rate,
round(count(*) FILTER (value <> 0) / count(value), 6) AS exposure, round(sum(value) FILTER (value > 0) / nullif(-sum(value) FILTER (value < 0), 0), 5) AS profit_factor FROM m GROUP BY series""")
def performance(spark, sf_dir):
    found = trading.performance(_returns(spark, sf_dir), "value", ["series"], ["date"])
    digits = {"mean": 8, "sharpe": 5, "sortino": 5, "growth": 6, "max_drawdown": 6, "hit_rate": 6, "exposure": 6, "profit_factor": 5}
    return found.select("series", "n", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(STATES + """SELECT series, max(date) AS date, CASE WHEN arg_max(day(date), date) > 15 OR series = '1-URGENT' THEN 'FLAT' ELSE CASE arg_max(position, date) WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'FLAT' END END AS state,
CASE WHEN arg_max(day(date), date) > 15 OR series = '1-URGENT' THEN 'NONE' ELSE coalesce(CASE (SELECT reason FROM states q WHERE q.series = states.series ORDER BY date DESC LIMIT 1) WHEN 'enter' THEN 'ENTER_' || CASE WHEN arg_max(position, date) > 0 THEN 'LONG' ELSE 'SHORT' END
  WHEN 'stop' THEN 'STOP' WHEN 'exit' THEN 'EXIT' WHEN 'time' THEN 'EXIT' END, 'NONE') END AS action FROM states GROUP BY series""")
def signal_documents(spark, sf_dir):
    """The last signal of each series; the day of the month stands for an input's age, one series for a regime not trusted."""
    rows = _states(spark, sf_dir).withColumn("age", F.dayofmonth("date"))
    return trading.signal_documents(rows, ["series"], "date", {"age": 15}, F.col("series") == "1-URGENT", ["z", "position"]).drop("document")


@query(f"""WITH {PRICES}, e AS (SELECT series, date, sum(mean - 150000) OVER w AS equity FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)),
p AS (SELECT series, date, equity, greatest(max(equity) OVER (PARTITION BY series ORDER BY date), 0) AS peak FROM e) SELECT series, date, round(equity, 4) AS equity, round(equity - peak, 4) AS drawdown FROM p""")
def drawdowns(spark, sf_dir):
    rows = _prices(spark, sf_dir).select("series", "date", (F.col("mean") - 150000).alias("r"))
    return trading.drawdown(rows, "r", ["series"], ["date"]).select("series", "date", F.round("equity", 4).alias("equity"), F.round("drawdown", 4).alias("drawdown"))


#: The regression of changes on the level and the change before, by sums.
ROOT = """, d AS (SELECT series, v - lag(v) OVER w AS y, lag(v) OVER w AS x, lag(v) OVER w - lag(v, 2) OVER w AS z FROM u WINDOW w AS (PARTITION BY series ORDER BY date)), k AS (SELECT * FROM d WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL)"""


@query(f"""WITH {PRICES}, u AS (SELECT series, date, mean AS v FROM prices){ROOT},
q AS (SELECT series, count(*) AS n, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz, regr_sxy(z, x) AS xz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, regr_syy(y, x) AS yy FROM k GROUP BY series),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM q)
SELECT series, n, round(bx / sqrt((yy - bx * xy - bz * zy) / (n - 3) * zz / (xx * zz - xz * xz)), 5) AS statistic, round(-2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3, 6) AS critical_5 FROM b""")
def dickey_fuller(spark, sf_dir):
    found = models.dickey_fuller(_prices(spark, sf_dir), "mean", ["series"], ["date"])
    return found.select("series", "n", F.round("statistic", 5).alias("statistic"), F.round("critical_5", 6).alias("critical_5"))


@query(f"""WITH {PRICES}, c AS (SELECT series, date, mean - avg(mean) OVER (PARTITION BY series) AS e FROM prices),
l AS (SELECT series, e, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM c WINDOW w AS (PARTITION BY series ORDER BY date))
SELECT series, count(*) AS n, round(sum(s * s) / count(*) / (sum(e * e) + 2 * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3))), 6) AS statistic FROM l GROUP BY series""")
def kpss(spark, sf_dir):
    return models.kpss(_prices(spark, sf_dir), "mean", ["series"], ["date"], lags=3).select("series", "n", F.round("statistic", 6).alias("statistic"))


def _engle_granger_sql(dependent: str, y: str, x: str) -> str:
    return f"""SELECT series, '{dependent}' AS dependent, slope, intercept, n, round(bx / sqrt((yy - bx * xy - bz * zy) / (n - 2) * zz / (xx * zz - xz * xz)), 4) AS statistic FROM (
SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM (
SELECT series, any_value(slope) AS slope, any_value(intercept) AS intercept, count(*) AS n, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM (
SELECT series, slope, intercept, v - lag(v) OVER w AS y, lag(v) OVER w AS x, lag(v) OVER w - lag(v, 2) OVER w AS z FROM (
SELECT p.series, date, {y} - f.intercept - f.slope * {x} AS v, round(f.slope, 6) AS slope, round(f.intercept, 3) AS intercept FROM prices p JOIN (SELECT series, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept FROM prices GROUP BY series) f USING (series))
WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE y IS NOT NULL AND z IS NOT NULL GROUP BY series))"""


@query(f"WITH {PRICES} " + _engle_granger_sql("price", "price", "n") + " UNION ALL " + _engle_granger_sql("n", "n", "price"))
def engle_granger(spark, sf_dir):
    found = models.engle_granger(_prices(spark, sf_dir), "price", "n", ["series"], ["date"])
    return found.select("series", "dependent", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n", F.round("statistic", 4).alias("statistic"))


#: Every window fitted anew: its line, its residual, and the regression of that.
WINDOWED = f"""{PRICES}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM prices),
w AS (SELECT series, date, k, regr_slope(price, n) OVER b AS s, regr_intercept(price, n) OVER b AS c FROM p WINDOW b AS (PARTITION BY series ORDER BY k ROWS 499 PRECEDING)),
j AS (SELECT w.series, w.k, p.k AS t, p.price - c - s * p.n AS e FROM w JOIN p ON p.series = w.series AND p.k BETWEEN w.k - 499 AND w.k WHERE w.k >= 500),
l AS (SELECT series, k, e - lag(e) OVER o AS y, lag(e) OVER o AS x, lag(e) OVER o - lag(e, 2) OVER o AS z FROM j WINDOW o AS (PARTITION BY series, k ORDER BY t)),
q AS (SELECT series, k, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM l WHERE z IS NOT NULL GROUP BY series, k),
fits AS (SELECT series, k, bx / sqrt((yy - bx * xy - bz * zy) / 496 * zz / (xx * zz - xz * xz)) AS statistic FROM (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM q)),
tests AS (SELECT w.series, w.date, w.k, round(statistic, 4) AS statistic, statistic < -3.33613 - 6.1101 / 498 - 6.823 / 498 ** 2 AS rejects FROM w LEFT JOIN fits USING (series, k))"""


@query(f"WITH {WINDOWED} SELECT series, date, statistic, rejects FROM tests")
def rolling_cointegration(spark, sf_dir):
    found = rolling.rolling_engle_granger(_prices(spark, sf_dir), "price", "n", ["series"], ["date"], rows=500)
    return found.withColumn("statistic", F.round("statistic", 4))


@query(None)
def johansen(spark, sf_dir):
    """Held in the tests against a plain computation by the definition, and on series that share a trend."""
    return models.johansen(_prices(spark, sf_dir), "price", "mean", ["series"], ["date"])


@query(f"""WITH {PRICES}, i AS (SELECT series, price AS y, n AS x, row_number() OVER (PARTITION BY series ORDER BY date) AS k, count(*) OVER (PARTITION BY series) AS rows_ FROM prices),
w AS (SELECT series, k, rows_, regr_syy(y, x) OVER a - coalesce(regr_sxy(y, x) OVER a ** 2 / nullif(regr_sxx(y, x) OVER a, 0), 0) AS left_, regr_syy(y, x) OVER b - coalesce(regr_sxy(y, x) OVER b ** 2 / nullif(regr_sxx(y, x) OVER b, 0), 0) AS right_ FROM i
  WINDOW a AS (PARTITION BY series ORDER BY k ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY series ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
best AS (SELECT series, arg_min(k, left_ + right_) AS cut, min(left_ + right_) AS rss, any_value(rows_) AS n FROM w WHERE k >= 30 AND rows_ - k >= 30 GROUP BY series),
whole AS (SELECT series, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS rss0 FROM i GROUP BY series),
c AS (SELECT series, n, n * ln(rss / n) + 5 * ln(n) < n * ln(rss0 / n) + 2 * ln(n) AS broken, cut FROM best JOIN whole USING (series))
SELECT series, broken::BIGINT AS n_breaks, 0::BIGINT AS segment, 0::BIGINT AS first, CASE WHEN broken THEN cut ELSE n END - 1 AS last FROM c UNION ALL SELECT series, 1, 1, cut, n - 1 FROM c WHERE broken""")
def structural_breaks(spark, sf_dir):
    """One break at most here; tests hold several against all cuts."""
    return models.breaks(_prices(spark, sf_dir), "price", "n", ["series"], ["date"], most=1).select("series", "n_breaks", "segment", "first", "last")


def _cuts_sql(cost: str, sums: str, source: str, free: int, each: int, kind: str) -> str:
    """The best of no, one and two cuts over all of them; cost is of the rows i + 1 to j, from the prefix sums a (up to i) and b (up to j)."""
    return f"""p AS (SELECT series, 0::BIGINT AS k, {", ".join(f"0.0::DOUBLE AS {name}" for name, _ in [x.split(":") for x in sums.split(";")])} FROM (SELECT DISTINCT series FROM {source}) UNION ALL
  SELECT series, k, {", ".join(f"sum({value}) OVER w AS {name}" for name, value in [x.split(":") for x in sums.split(";")])} FROM {source} WINDOW w AS (PARTITION BY series ORDER BY k)),
size AS (SELECT series, max(k) AS n FROM p GROUP BY series),
seg AS (SELECT a.series, a.k AS i, b.k AS j, {cost} AS c FROM p a JOIN p b ON a.series = b.series AND b.k - a.k >= 30 JOIN size s ON s.series = a.series WHERE a.k = 0 OR b.k = s.n OR a.k >= 30 AND s.n - b.k >= 30),
ways AS (SELECT s.series, 0 AS m, c AS total, NULL::BIGINT AS c1, NULL::BIGINT AS c2 FROM seg JOIN size s ON s.series = seg.series WHERE i = 0 AND j = n
  UNION ALL SELECT x.series, 1, min(x.c + y.c), arg_min(x.j, x.c + y.c), NULL FROM seg x JOIN seg y ON x.series = y.series AND x.i = 0 AND y.i = x.j JOIN size s ON s.series = x.series WHERE y.j = n GROUP BY x.series
  UNION ALL SELECT x.series, 2, min(x.c + y.c + z.c), arg_min(x.j, x.c + y.c + z.c), arg_min(y.j, x.c + y.c + z.c) FROM seg x JOIN seg y ON x.series = y.series AND x.i = 0 AND y.i = x.j JOIN seg z ON z.series = y.series AND z.i = y.j JOIN size s ON s.series = x.series WHERE z.j = n AND y.i > 0 GROUP BY x.series),
best AS (SELECT ways.*, n FROM ways JOIN size USING (series) QUALIFY row_number() OVER (PARTITION BY series ORDER BY {"n * ln(total / n)" if kind == "rss" else "total"} + ({each} * m + {free}) * ln(n)) = 1),
bounds AS (SELECT series, m, n, unnest(CASE m WHEN 0 THEN [0] WHEN 1 THEN [0, c1] ELSE [0, c1, c2] END) AS first FROM best)
SELECT series, m::BIGINT AS n_breaks, row_number() OVER (PARTITION BY series ORDER BY first) - 1 AS segment, first, coalesce(lead(first) OVER (PARTITION BY series ORDER BY first), n) - 1 AS last FROM bounds"""


@query(f"""WITH {PRICES}, m AS (SELECT series, avg(price) AS py, avg(n) AS px FROM prices GROUP BY series),
i AS (SELECT series, price - py AS v, n - px AS u, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM prices JOIN m USING (series) WHERE year(date) >= 1999),
""" + _cuts_sql("(b.vv - a.vv) - (b.v - a.v) ** 2 / (b.k - a.k) - coalesce(((b.uv - a.uv) - (b.u - a.u) * (b.v - a.v) / (b.k - a.k)) ** 2 / nullif((b.uu - a.uu) - (b.u - a.u) ** 2 / (b.k - a.k), 0), 0)", "u:u;v:v;uu:u * u;uv:u * v;vv:v * v", "i", 2, 3, "rss"))
def several_breaks(spark, sf_dir):
    """Up to two breaks of the line since 1999, against all cuts."""
    rows = _prices(spark, sf_dir).filter(F.year("date") >= 1999)
    return models.breaks(rows, "price", "n", ["series"], ["date"], most=2).select("series", "n_breaks", "segment", "first", "last")


@query(f"""WITH {PRICES}, r AS (SELECT series, date, mean - 150000 + CASE WHEN year(date) = 2000 THEN 3 * (mean - 150000) ELSE 0 END AS e FROM prices WHERE year(date) >= 1999), i AS (SELECT series, e, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM r),
""" + _cuts_sql("(b.k - a.k) * ln((b.q - a.q) / (b.k - a.k))", "q:e * e", "i", 1, 2, "log"))
def variance_breaks(spark, sf_dir):
    """Up to two breaks of the variance of a residual that is wider in one year, against all cuts."""
    wide = F.when(F.year("date") == 2000, 4).otherwise(1)
    rows = _prices(spark, sf_dir).filter(F.year("date") >= 1999).withColumn("e", (F.col("mean") - 150000) * wide)
    return models.variance_breaks(rows, "e", ["series"], ["date"], most=2).select("series", "n_breaks", "segment", "first", "last")


@query(None)
def unit_root_tests(spark, sf_dir):
    """Both tests with p-values and chosen lags; held in the tests against published values and plain regressions."""
    return models.unit_roots(_prices(spark, sf_dir), "mean", ["series"], ["date"])


@query(None)
def cointegration_tests(spark, sf_dir):
    """Both orderings with p-values and chosen lags; held in the tests as above."""
    return models.cointegration(_prices(spark, sf_dir), "price", "n", ["series"], ["date"])


@query(None)
def johansen_three(spark, sf_dir):
    """Three series with 10, 5 and 1 % values; held in the tests against the definition."""
    return models.johansen_of(_prices(spark, sf_dir), ["price", "n", "mean"], ["series"], ["date"])


@query(f"""WITH RECURSIVE {CLOSES}, i AS (SELECT user_id AS series, obs_date, value AS y, day(obs_date) / 10.0 AS x, row_number() OVER (PARTITION BY user_id ORDER BY obs_date) AS k FROM closes),
f AS (SELECT series, 0::BIGINT AS k, NULL::DATE AS obs_date, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS r, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS b0 FROM (SELECT DISTINCT series FROM i)
UNION ALL SELECT series, k, obs_date, a + u / s * e, b + v / s * e, p - u / s * u, q - u / s * v, r - v / s * v, a, b FROM (SELECT *, u + x * v + 1e-2 AS s, y - a - b * x AS e FROM (
  SELECT i.series, i.k, i.obs_date, i.x::DOUBLE AS x, i.y, f.a, f.b, f.p + 1e-4 AS p, f.q, f.r + 1e-4 AS r, f.p + 1e-4 + f.q * i.x::DOUBLE AS u, f.q + (f.r + 1e-4) * i.x::DOUBLE AS v FROM f JOIN i ON i.series = f.series AND i.k = f.k + 1)))
SELECT series, obs_date, round(a0, 4) AS alpha, round(b0, 4) AS beta FROM f WHERE k > 0""")
def kalman_beta(spark, sf_dir):
    rows = _closes(spark, sf_dir).withColumn("x", F.dayofmonth("obs_date") / 10.0)
    return filters.kalman(rows, "value", "x", ["series"], ["obs_date"]).select("series", "obs_date", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


# --- sweeps, trades, significance, the daily run ---------------------------------------

GRID = sweeps.Grid(z=("z60", "z120"), enter=(1.5, 2.0, 2.5), leave=(0.25, 0.5))
#: The fold and the returns of every cell, row by row.
CELLS = f"""WITH RECURSIVE {PRICES}, zw AS (SELECT series, date, mean, n, count(*) OVER a AS ka, avg(mean) OVER a AS ma, stddev_samp(mean) OVER a AS sa, count(*) OVER b AS kb, avg(mean) OVER b AS mb, stddev_samp(mean) OVER b AS sb, row_number() OVER o AS k FROM prices
  WINDOW o AS (PARTITION BY series ORDER BY date), a AS (PARTITION BY series ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
i AS (SELECT series, date, mean, n, k, CASE WHEN ka = 60 THEN round((mean - ma) / nullif(sa, 0), 5) END AS z0, CASE WHEN kb = 120 THEN round((mean - mb) / nullif(sb, 0), 5) END AS z1 FROM zw),
g(i_z, i_enter, i_leave, e, l) AS (VALUES {", ".join(f"({c[0]}, {c[1]}, {c[2]}, {GRID.enter[c[1]]}, {GRID.leave[c[2]]})" for c in GRID.cells())}),
f AS (SELECT series, g.*, 0::BIGINT AS k, 0 AS position, 0 AS held, false AS barred, NULL::VARCHAR AS reason FROM (SELECT DISTINCT series FROM i), g
UNION ALL SELECT series, i_z, i_enter, i_leave, e, l, k, CASE WHEN p <> 0 THEN CASE WHEN reason IS NULL THEN p ELSE 0 END WHEN reason = 'enter' THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END,
  CASE WHEN p <> 0 THEN held + 1 ELSE 0 END, coalesce(reason = 'stop', false) OR barred AND NOT coalesce(abs(z) <= l, false), reason
FROM (SELECT *, CASE WHEN p <> 0 THEN CASE WHEN abs(z) >= 3.5 THEN 'stop' WHEN abs(z) <= l THEN 'exit' WHEN held + 1 >= 60 THEN 'time' END WHEN abs(z) >= e AND abs(z) < 3.5 AND NOT barred THEN 'enter' END AS reason
  FROM (SELECT f.series, f.i_z, f.i_enter, f.i_leave, f.e, f.l, i.k, f.position AS p, f.held, f.barred, CASE f.i_z WHEN 0 THEN i.z0 ELSE i.z1 END AS z FROM f JOIN i ON i.series = f.series AND i.k = f.k + 1))),
h AS (SELECT f.*, year(i.date) AS yr, lag(position, 1, 0) OVER w AS own, i.mean / lag(i.mean) OVER w - 1 AS move, coalesce(lag(i.n) OVER w, 0) AS carry FROM f JOIN i USING (series, k) WINDOW w AS (PARTITION BY series, i_z, i_enter, i_leave ORDER BY k)),
m AS (SELECT *, abs(own - lag(own, 1, 0) OVER (PARTITION BY series, i_z, i_enter, i_leave ORDER BY k)) AS moved FROM h),
v AS (SELECT *, own * move + own * carry / 100 / 252 - moved * 2.0 / 1e4 AS value FROM m),
eq AS (SELECT *, sum(value) OVER (PARTITION BY series, i_z, i_enter, i_leave ORDER BY k) AS equity FROM v),
dd AS (SELECT *, equity - greatest(max(equity) OVER (PARTITION BY series, i_z, i_enter, i_leave ORDER BY k), 0) AS down FROM eq),
cells AS (SELECT series, i_z, i_enter, i_leave, e, l, count(value) AS n, sum(value) AS pnl, avg(value) AS a1, avg(value ** 2) AS a2, avg(value ** 3) AS a3, avg(value ** 4) AS a4, stddev_samp(value) AS sd, stddev_pop(value) AS sp, min(down) AS max_drawdown,
  count(*) FILTER (value <> 0) / nullif(count(value), 0) AS exposure, count(*) FILTER (reason = 'enter') AS n_trades, count(*) FILTER (reason = 'stop') AS n_stops, sum(moved)::DOUBLE AS turnover, sum(CASE WHEN value IS NOT NULL THEN moved * 2.0 / 1e4 END) AS cost FROM dd GROUP BY ALL)
"""


def _cells(spark: SparkSession, sf_dir: str, block: str | None = None) -> DataFrame:
    rows = stats.rolling_zscore(_prices(spark, sf_dir), "mean", ["series"], ["date"], 60).withColumn("z60", F.round("z", 5))
    rows = stats.rolling_zscore(rows, "mean", ["series"], ["date"], 120).withColumn("z120", F.round("z", 5))
    return sweeps.sweep(rows.withColumn("year", F.year("date")), GRID, "mean", ["series"], ["date"], carry="n", cost_bps=2.0, block=block)


@query(CELLS + """SELECT series, CASE i_z WHEN 0 THEN 'z60' ELSE 'z120' END AS z, e::DOUBLE AS enter, l::DOUBLE AS leave, n, round(pnl, 6) AS pnl, round(a1 / nullif(sd, 0), 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(exposure, 6) AS exposure,
n_trades, n_stops, turnover, round(cost, 6) AS cost FROM cells""")
def parameter_sweep(spark, sf_dir):
    """Every cell of windows, entries and exits in one pass over each series."""
    rounded = [F.round(c, 6).alias(c) for c in ("pnl", "sharpe", "max_drawdown", "exposure")]
    return _cells(spark, sf_dir).select("series", "z", "enter", "leave", "n", *rounded, "n_trades", "n_stops", "turnover", F.round("cost", 6).alias("cost"))


@query(CELLS.rstrip() + """, near AS (SELECT a.series, a.i_z, a.i_enter, a.i_leave, any_value(a.pnl) AS pnl, avg(b.pnl) AS near FROM cells a LEFT JOIN cells b ON a.series = b.series AND abs(a.i_z - b.i_z) + abs(a.i_enter - b.i_enter) + abs(a.i_leave - b.i_leave) = 1 GROUP BY ALL),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY series ORDER BY pnl DESC, i_z, i_enter, i_leave) = 1),
t AS (SELECT series, count(pnl) AS n_cells, count(*) FILTER (pnl > 0) / count(pnl) AS share, nullif(stddev_pop(pnl), 0) AS sd, avg((pnl - near) ** 2) AS rough FROM near GROUP BY series)
SELECT series, n_cells, round(share, 6) AS share_positive, round(best.pnl, 6) AS best, round(best.near, 6) AS neighbours, round((best.pnl - best.near) / sd, 4) AS spike, round(rough / sd ** 2, 4) AS roughness FROM t JOIN best USING (series)""")
def sweep_surface(spark, sf_dir):
    """Whether the P&L is smooth over the grid, or one spike."""
    found = sweeps.surface(_cells(spark, sf_dir), ["series"])
    return found.select("series", "n_cells", *[F.round(c, k).alias(c) for c, k in {"share_positive": 6, "best": 6, "neighbours": 6, "spike": 4, "roughness": 4}.items()])


@query(CELLS.rstrip() + """, years AS (SELECT series, i_z, i_enter, i_leave, e, l, yr, count(value) AS n, sum(value) AS pnl FROM v GROUP BY ALL),
past AS (SELECT *, sum(pnl) OVER b AS in_sample, sum(n) OVER b AS in_rows FROM years WINDOW b AS (PARTITION BY series, i_z, i_enter, i_leave ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
picked AS (SELECT * FROM past WHERE in_sample IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series, yr ORDER BY in_sample DESC, i_z, i_enter, i_leave) = 1)
SELECT series, yr::INTEGER AS year, CASE i_z WHEN 0 THEN 'z60' ELSE 'z120' END AS z, e::DOUBLE AS enter, l::DOUBLE AS leave, round(in_sample, 6) AS in_sample, in_rows::BIGINT AS in_rows, round(pnl, 6) AS out_of_sample, n AS out_rows FROM picked""")
def walk_forward_sweep(spark, sf_dir):
    """Each year traded with the cell that was best in the years before, beside what that cell had made there."""
    found = sweeps.out_of_sample(_cells(spark, sf_dir, "year"), ["series"], "year")
    return found.select("series", "year", "z", "enter", "leave", F.round("in_sample", 6).alias("in_sample"), "in_rows", F.round("out_of_sample", 6).alias("out_of_sample"), "out_rows")


def _poly_sql(x: str, powers: tuple[float, ...]) -> str:
    out = repr(powers[0]) + "::DOUBLE"
    for c in powers[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _cdf_sql(x: str) -> str:
    """As the quotient of polynomials within seven deviations, which these figures never leave."""
    above = f"exp(-(({x}) ** 2) / 2) * {_poly_sql(f'abs({x})', significance.CDF_TOP)} / {_poly_sql(f'abs({x})', significance.CDF_BOTTOM)}"
    return f"CASE WHEN ({x}) > 0 THEN 1 - {above} ELSE {above} END"


def _inverse_sql(p: str) -> str:
    q, r = f"(({p}) - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    middle = f"{q} * {_poly_sql(f'({q} ** 2)', significance.INVERSE_A)} / {_poly_sql(f'({q} ** 2)', significance.INVERSE_B)}"
    tail = f"{_poly_sql(r, significance.INVERSE_C)} / {_poly_sql(r, significance.INVERSE_D)}"
    return f"CASE WHEN least({p}, 1 - ({p})) >= {significance.TAIL} THEN {middle} WHEN ({p}) < 0.5 THEN {tail} ELSE -({tail}) END"


@query(CELLS.rstrip() + f""", c AS (SELECT *, a1 / sd AS sharpe, (a3 - 3 * a1 * a2 + 2 * a1 ** 3) / sp ** 3 AS skew, (a4 - 4 * a1 * a3 + 6 * a1 ** 2 * a2 - 3 * a1 ** 4) / sp ** 4 AS kurt FROM cells WHERE sd > 0),
t AS (SELECT series, count(*) AS n_trials, stddev_samp(sharpe) AS spread FROM c GROUP BY series), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY sharpe DESC, i_z, i_enter, i_leave) = 1),
x AS (SELECT *, coalesce(spread * ((1 - {significance.EULER}) * ({_inverse_sql("(1 - 1.0 / n_trials)")}) + {significance.EULER} * ({_inverse_sql("(1 - 1.0 / (n_trials * exp(1.0)))")})), 0) AS expected FROM t JOIN b USING (series)),
y AS (SELECT *, sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe ** 2) AS width FROM x)
SELECT series, n_trials, round(sharpe, 6) AS sharpe, round(expected, 6) AS expected, round({_cdf_sql("((sharpe - expected) * width)")}, 6) AS deflated, round({_cdf_sql("(sharpe * width)")}, 6) AS undeflated FROM y""")
def deflated_sharpe(spark, sf_dir):
    """The best cell's ratio against the greatest that as many trials would show by chance."""
    found = significance.deflated_sharpe(_cells(spark, sf_dir), ["series"], sweeps.AXES)
    return found.select("series", "n_trials", *[F.round(c, 6).alias(c) for c in ("sharpe", "expected", "deflated", "undeflated")])


@query(RETURNS.rstrip() + """, kept AS MATERIALIZED (SELECT series, value AS x, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM v WHERE value IS NOT NULL),
whole AS (SELECT series, count(*) AS n, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe FROM kept GROUP BY series),
picks AS (SELECT series, draw, n, ('0x' || substr(md5('7|' || series || '|' || draw || '|' || slot), 1, 12))::BIGINT % n AS start FROM whole, generate_series(0, 199) d(draw), generate_series(0, 1000) t(slot) WHERE slot < ceil(n / 20.0)),
places AS MATERIALIZED (SELECT series, draw, unnest([(start + o) % n for o in range(20)]) AS i FROM picks),
made AS (SELECT series, draw, avg(x) / stddev_samp(x) * sqrt(252) AS r FROM places JOIN kept USING (series, i) GROUP BY series, draw)
SELECT series, any_value(n) AS n, round(any_value(sharpe), 5) AS sharpe, count(r) AS n_draws, round(quantile_cont(r, 0.05), 5) AS low, round(quantile_cont(r, 0.95), 5) AS high, count(*) FILTER (r <= 0) / count(r) AS share_not_positive FROM whole JOIN made USING (series) GROUP BY series""")
def bootstrap_sharpe(spark, sf_dir):
    """Ratios of resampled blocks of returns."""
    found = significance.bootstrap_sharpe(_returns(spark, sf_dir), "value", ["series"], ["date"], draws=200, block=20)
    return found.select("series", "n", F.round("sharpe", 5).alias("sharpe"), "n_draws", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "share_not_positive")


#: Trades by their entries, each with the first way out after it.
LEDGER = RETURNS.rstrip() + """, en AS (SELECT series, date AS entry, position AS side, row_number() OVER (PARTITION BY series ORDER BY date) AS trade FROM states WHERE reason = 'enter'),
ways AS (SELECT en.*, (SELECT min(x.date) FROM states x WHERE x.series = en.series AND x.date > en.entry AND x.reason IN ('exit', 'stop', 'time')) AS exit FROM en),
spans AS (SELECT ways.*, (SELECT min(x.date) FROM states x WHERE x.series = ways.series AND x.date > ways.exit) AS paid FROM ways),
own AS (SELECT spans.*, v.date, v.spot, v.carry_return, v.cost + CASE WHEN v.date = spans.exit AND paid IS NOT NULL THEN 2.0 / 1e4 ELSE 0 END AS cost FROM spans JOIN v ON v.series = spans.series AND v.date > spans.entry AND (spans.exit IS NULL OR v.date <= spans.exit)),
along AS (SELECT *, spot + carry_return - cost AS gain, sum(spot + carry_return - cost) OVER (PARTITION BY series, trade ORDER BY date) AS running FROM own),
ledger AS (SELECT series, trade, any_value(side) AS side, any_value(entry) AS entry, any_value(exit) AS exit, count(*) AS n_rows, sum(spot) AS spot, sum(carry_return) AS carry, sum(cost) AS cost, sum(gain) AS pnl, least(min(running), 0) AS worst,
  (1 + CASE WHEN any_value(paid) IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS turnover FROM along GROUP BY series, trade),
book AS (SELECT l.*, x.reason, a.mean AS entry_price, b.mean AS exit_price FROM ledger l JOIN prices a ON a.series = l.series AND a.date = l.entry LEFT JOIN prices b ON b.series = l.series AND b.date = l.exit LEFT JOIN states x ON x.series = l.series AND x.date = l.exit)
"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trades(_returns(spark, sf_dir), "position", "mean", ["series"], ["date"], "reason")


@query(LEDGER + """SELECT series, trade, side, entry, exit, reason, n_rows, entry_price, exit_price, round(spot, 6) AS spot, round(carry, 8) AS carry, round(cost, 8) AS cost, round(pnl, 6) AS pnl, round(worst, 6) AS worst, turnover FROM book""")
def trade_ledger(spark, sf_dir):
    """Every trade with its entry, exit, reason and what it earned."""
    digits = {"spot": 6, "carry": 8, "cost": 8, "pnl": 6, "worst": 6}
    return _ledger(spark, sf_dir).select("series", "trade", "side", F.col("entry.date").alias("entry"), F.col("exit.date").alias("exit"), "reason", "n_rows", "entry_price", "exit_price", *[F.round(c, k).alias(c) for c, k in digits.items()], "turnover")


@query(LEDGER + """SELECT series, count(*) AS n_trades, count(*) FILTER (exit IS NULL) AS n_open, count(*) FILTER (side > 0) AS n_long, count(*) FILTER (reason = 'exit') AS n_exit, count(*) FILTER (reason = 'stop') AS n_stop, count(*) FILTER (reason = 'time') AS n_time,
round(count(*) FILTER (exit IS NOT NULL AND pnl > 0) / count(exit), 6) AS hit_rate, round(avg(n_rows) FILTER (exit IS NOT NULL), 6) AS mean_rows, round(avg(pnl) FILTER (exit IS NOT NULL), 6) AS mean_pnl,
round(sum(pnl) FILTER (exit IS NOT NULL AND pnl > 0) / -sum(pnl) FILTER (exit IS NOT NULL AND pnl < 0), 5) AS profit_factor, round(sum(spot), 6) AS spot, round(sum(carry), 6) AS carry, round(sum(cost), 6) AS cost, round(sum(pnl), 6) AS pnl, sum(turnover) AS turnover, round(min(worst), 6) AS worst FROM book GROUP BY series""")
def trade_figures(spark, sf_dir):
    """Holding periods, turnover and hit rates of the ledger."""
    digits = {"hit_rate": 6, "mean_rows": 6, "mean_pnl": 6, "profit_factor": 5, "spot": 6, "carry": 6, "cost": 6, "pnl": 6, "worst": 6}
    found = ledger.trade_figures(_ledger(spark, sf_dir), ["series"])
    return found.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in found.columns])


@query(STATES.rstrip() + """, q AS (SELECT series, date, mean, mean / lag(mean) OVER (PARTITION BY series ORDER BY date) - 1 AS move FROM prices),
w AS (SELECT *, count(move) OVER a AS k, stddev_samp(move) OVER a AS sd FROM q WINDOW a AS (PARTITION BY series ORDER BY date ROWS 59 PRECEDING)),
z AS (SELECT s.series, s.date, s.position * CASE WHEN k = 60 AND sd > 0 THEN least(0.5 / (sd * sqrt(252)), 3) ELSE 1 END AS size, w.mean, lag(w.mean) OVER o AS before FROM states s JOIN w USING (series, date) WINDOW o AS (PARTITION BY s.series ORDER BY s.date)),
y AS (SELECT *, lag(size, 1, 0) OVER o AS held, coalesce(lag(size, 2) OVER o, 0) AS was FROM z WINDOW o AS (PARTITION BY series ORDER BY date))
SELECT series, date, round(size, 6) AS size, round(held * (mean / before - 1) - abs(held - was) * 2.0 / 1e4, 6) + 0.0 AS value FROM y""")
def scaled_backtest(spark, sf_dir):
    """Positions scaled to a volatility, in place of one notional."""
    rows = trading.volatility_scaled(_states(spark, sf_dir).join(_prices(spark, sf_dir), ["series", "date"]), "position", "mean", ["series"], ["date"], target=0.5)
    found = trading.backtest(rows, "size", "mean", ["series"], ["date"], cost_bps=2.0)
    return found.select("series", "date", F.round("size", 6).alias("size"), F.round("value", 6).alias("value"))


@query(f"""WITH {PRICES}, k AS (SELECT series, date, mean, row_number() OVER o AS k, lag(mean) OVER o AS x, mean - lag(mean) OVER o AS y FROM prices WINDOW o AS (PARTITION BY series ORDER BY date)),
h AS (SELECT *, CASE WHEN k > 250 THEN regr_slope(y, x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 249 PRECEDING AND 1 PRECEDING) END AS kappa FROM k),
w AS (SELECT *, CASE WHEN kappa < 0 THEN least(greatest(round(-ln(2) / kappa * 20), 5), 120)::INTEGER END AS window_rows FROM h)
SELECT w.series, w.date, any_value(w.window_rows) AS window_rows, round((any_value(w.mean) - avg(q.mean)) / nullif(stddev_samp(q.mean), 0), 5) AS z FROM w LEFT JOIN k q ON q.series = w.series AND q.k BETWEEN w.k - w.window_rows AND w.k - 1 GROUP BY w.series, w.date""")
def half_life_windows(spark, sf_dir):
    """z-scores over windows of twenty half-lives, each row's own."""
    rows = rolling.rolling_half_life(_prices(spark, sf_dir), "mean", ["series"], ["date"], rows=250)
    rows = rows.withColumn("window_rows", rolling.window_rows(F.col("half_life"), 20, 5, 120))
    return rolling.zscore_of_length(rows, "mean", "window_rows", ["series"], ["date"]).select("series", "date", "window_rows", F.round("z", 5).alias("z"))


def _run_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the history of four runs over rows that arrive by years, one of them a second time."""
    folder, rows = landing.scratch(spark), rolling_zscore(spark, sf_dir)
    for first, last in ((0, 1996), (1997, 1998), (1997, 1998), (1999, 9999)):
        rows.filter(F.year("date").between(first, last)).write.mode("append").parquet(f"{folder}/rows")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{folder}/rows")
        signals.run_signals(arrived, "z", ["series"], "date", folder)
    return folder


@query(STATES + "SELECT * FROM states")
def signal_run(spark, sf_dir):
    """The daily run's history equals one fold over all rows."""
    return signals.history(spark, _run_folder(spark, sf_dir))


@query(STATES.rstrip() + ", " + WINDOWED[len(PRICES) + 2 :] + """, guard AS (SELECT series, date, sum(CASE WHEN coalesce(rejects, false) THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY date ROWS 4 PRECEDING) >= 5 AS failed FROM tests),
newest AS (SELECT s.*, failed, day(s.date) > 15 AS stale, day(s.date) > 15 OR failed AS guarded, CASE WHEN s.position > 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM states s JOIN guard USING (series, date) QUALIFY row_number() OVER (PARTITION BY s.series ORDER BY s.date DESC) = 1)
SELECT series, date, CASE WHEN guarded OR position = 0 THEN 'FLAT' ELSE side END AS state, CASE WHEN guarded OR reason IS NULL THEN 'NONE' WHEN reason = 'enter' THEN 'ENTER_' || side WHEN reason = 'stop' THEN 'STOP' ELSE 'EXIT' END AS action,
'1.0' AS schema_version, CAST(date AS VARCHAR) AS as_of, z, position, CASE WHEN stale THEN 'age' ELSE '' END AS stale_inputs, concat_ws('; ', CASE WHEN stale THEN 'stale inputs' END, CASE WHEN failed THEN 'regime not trusted' END) AS warnings FROM newest""")
def signal_latest(spark, sf_dir):
    """The newest document of the daily run, read back: guarded by the age of its inputs (here the day of the month) and by five failed windows of the cointegration test."""
    guard = signals.failed_runs(rolling.rolling_engle_granger(_prices(spark, sf_dir), "price", "n", ["series"], ["date"], rows=500), "rejects", ["series"], "date", 5)
    inputs = guard.withColumn("age", F.dayofmonth("date")).select("series", "date", "age", "regime_failed")
    newest = signals.latest(signals.history(spark, _run_folder(spark, sf_dir)), ["series"], "date", inputs, {"age": 15}, F.col("regime_failed"), ["z", "position"])
    document = F.from_json("document", "schema_version string, as_of string, z double, position int, state string, action string, data_quality struct<stale_inputs: array<string>, warnings: array<string>>")
    found = newest.select("series", "date", document.alias("d"))
    return found.select("series", "date", "d.state", "d.action", "d.schema_version", "d.as_of", "d.z", "d.position", F.array_join("d.data_quality.stale_inputs", "; ").alias("stale_inputs"), F.array_join("d.data_quality.warnings", "; ").alias("warnings"))


# --- a whole alignment -----------------------------------------------------------------

#: The six series of the data model: every user's events belong to one of them, by user_id modulo 6; a day whose last event is a click has no observation.
NAMES = {1: "usdjpy", 2: "us2y", 3: "us10y", 4: "jgb2y", 5: "jgb10y", 6: "us10y_real"}


def _config(convention: str, start: str = "2024-01-01", end: str = "2024-01-30", validation: dict | None = None) -> Config:
    shifted = convention == "tokyo_close"
    exact = ["jgb2y", "jgb10y"] if shifted else ["usdjpy", "us2y", "us10y"]
    lags = {"usdjpy": 2, "us2y": 3, "us10y": 3, "us10y_real": 1} if shifted else {"jgb2y": 2, "jgb10y": 3, "us10y_real": 1}
    return parse({
        "project": {"start_date": start, "end_date": end},
        "sources": {"fred": {"series": {"us2y": "DGS2", "us10y": "DGS10"}}, "mof": {"tenors": {"jgb2y": "2Y", "jgb10y": "10Y"}}},
        "alignment": {"convention": convention, "drop_if_missing": exact, "asof_max_lag_days": lags},
        "validation": validation or {"bounds": {}, "required_start_before": "2024-01-05"},
    })


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), (F.pmod("user_id", F.lit(6)) + 1).cast("int"))
    events = _read(spark, sf_dir, "events").filter("ts is not null and user_id is not null")
    rows = events.select(names.alias("series"), F.to_date("ts").alias("obs_date"), F.when(F.col("event_type") != "click", F.col("value")).alias("value"), "ts", "event_id")
    return dedup.keep_last(rows, ["series", "obs_date"], ["ts", "event_id"]).filter("value is not null").select("series", "obs_date", "value")


def _aligned(spark: SparkSession, sf_dir: str, convention: str) -> align.Aligned:
    return align.align(spark, _observed(spark, sf_dir), _config(convention), list(NAMES.values()))


FEEDS = """closes AS (SELECT user_id, obs_date, value FROM (SELECT user_id % 6 + 1 AS user_id, CAST(ts AS DATE) AS obs_date, CASE WHEN event_type <> 'click' THEN value END AS value,
  row_number() OVER (PARTITION BY user_id % 6, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) WHERE r = 1 AND value IS NOT NULL)"""


def _aligned_sql(convention: str) -> str:
    rules = _config(convention).alignment
    shifted = {"fx": 1, "us": 1, "jgb": 0} if convention == "tokyo_close" else {"fx": 0, "us": 0, "jgb": 0}
    groups = {"usdjpy": "fx", "jgb2y": "jgb", "jgb10y": "jgb"}
    rows = ", ".join(f"({u}, '{n}', '{groups.get(n, 'us')}', {rules.asof_max_lag_days.get(n, 0)}, {shifted[groups.get(n, 'us')]}, {n in rules.drop_if_missing}, {n != 'us10y_real'})" for u, n in NAMES.items())
    return f"""WITH {FEEDS}, {CALENDAR}, {US_DAYS}, {JP_DAYS}, pol(user_id, series, grp, max_lag, shift, exact, required) AS (VALUES {rows}),
t AS (SELECT pol.*, cal.date, cal.back * shift AS back, CAST(cal.date - cal.back * shift AS DATE) AS target FROM cal CROSS JOIN pol),
a AS (SELECT t.*, c.obs_date AS o, c.value AS v FROM t ASOF LEFT JOIN closes c ON t.user_id = c.user_id AND t.target >= c.obs_date),
long AS (SELECT date, series, grp, exact, required, shift, back, CASE WHEN target - o <= max_lag THEN v END AS value, CASE WHEN target - o <= max_lag THEN CAST(date - o AS INTEGER) END AS lag_days FROM a),
w AS (SELECT date, max(value) FILTER (series = 'usdjpy') AS usdjpy, max(value) FILTER (series = 'us2y') AS us2y, max(value) FILTER (series = 'us10y') AS us10y, max(value) FILTER (series = 'jgb2y') AS jgb2y,
  max(value) FILTER (series = 'jgb10y') AS jgb10y, max(value) FILTER (series = 'us10y_real') AS us10y_real, max(lag_days) FILTER (grp = 'fx') AS fx_lag_days,
  max(lag_days) FILTER (grp = 'us' AND required) AS us_lag_days, max(lag_days) FILTER (grp = 'jgb') AS jgb_lag_days FROM long GROUP BY date),
daily AS (SELECT date, usdjpy, us2y, us10y, jgb2y, jgb10y, us2y - jgb2y AS spread2y, us10y - jgb10y AS spread10y, us10y_real, fx_lag_days, us_lag_days, jgb_lag_days FROM w
  WHERE usdjpy IS NOT NULL AND us2y IS NOT NULL AND us10y IS NOT NULL AND jgb2y IS NOT NULL AND jgb10y IS NOT NULL),
drops AS (SELECT date, series, CASE WHEN exact THEN 'missing_on_snapshot_date' ELSE 'stale_beyond_max_lag' END AS reason FROM long WHERE required AND value IS NULL),
holes AS (SELECT pol.series, cal.date, CASE WHEN grp <> 'jgb' AND us.date IS NOT NULL OR grp = 'jgb' AND jp.date IS NOT NULL THEN 'holiday' WHEN cal.date > DATE '2024-01-27' THEN 'publication_lag' ELSE 'unexplained' END AS reason
  FROM cal CROSS JOIN pol ANTI JOIN closes c ON pol.user_id = c.user_id AND cal.date = c.obs_date LEFT JOIN us ON cal.date = us.date LEFT JOIN jp ON cal.date = jp.date)
"""


REPORT = """, kept AS (SELECT * FROM long WHERE date IN (SELECT date FROM daily)), c AS (SELECT series, count(*) FILTER (NOT exact AND lag_days > back) AS carried_forward,
  count(*) FILTER (NOT exact AND lag_days > shift) AS carried_over_one, max(lag_days)::BIGINT AS max_lag FROM kept GROUP BY series)
SELECT 'rows_out' AS section, '' AS key, count(*) AS n FROM daily UNION ALL SELECT 'rows_dropped', '', count(DISTINCT date) FROM drops UNION ALL SELECT 'dropped', series || '/' || reason, count(*) FROM drops GROUP BY ALL
UNION ALL SELECT 'gaps', series || '/' || reason, count(*) FROM holes GROUP BY ALL UNION ALL SELECT 'carried_forward', series, carried_forward FROM c UNION ALL SELECT 'carried_over_one', series, carried_over_one FROM c
UNION ALL SELECT 'max_lag', series, max_lag FROM c"""


@query(_aligned_sql("ny_close") + "SELECT * FROM daily")
def aligned_daily(spark, sf_dir):
    return _aligned(spark, sf_dir, "ny_close").daily


@query(_aligned_sql("tokyo_close") + "SELECT * FROM daily")
def aligned_daily_tokyo(spark, sf_dir):
    return _aligned(spark, sf_dir, "tokyo_close").daily


@query(_aligned_sql("ny_close").rstrip() + REPORT)
def alignment_report(spark, sf_dir):
    return align.report_rows(_aligned(spark, sf_dir, "ny_close"))


@query(_aligned_sql("tokyo_close").rstrip() + REPORT)
def alignment_report_tokyo(spark, sf_dir):
    return align.report_rows(_aligned(spark, sf_dir, "tokyo_close"))


@query(_aligned_sql("ny_close") + """SELECT '1.0' AS schema_version, 'ny_close' AS convention, (SELECT count(*) FROM daily) AS row_count, (SELECT CAST(min(date) AS VARCHAR) FROM daily) AS first, (SELECT CAST(max(date) AS VARCHAR) FROM daily) AS last,
(SELECT count(DISTINCT date) FROM drops) AS rows_dropped, series, count(c.value) AS n_rows, CAST(min(obs_date) AS VARCHAR) AS series_first, CAST(max(obs_date) AS VARCHAR) AS series_last FROM pol JOIN closes c USING (user_id) GROUP BY series""")
def run_metadata(spark, sf_dir):
    """The metadata document of a run, a row for each series."""
    observed, config = _observed(spark, sf_dir), _config("ny_close")
    document = provenance.metadata(observed, align.align(spark, observed, config, list(NAMES.values())), config)
    first, last = document["range"] or (None, None)
    rows = [(document["schema_version"], document["convention"], document["row_count"], first, last, document["alignment"]["rows_dropped"], r["series"], r["n_rows"], str(r["first"]), str(r["last"])) for r in document["series"]]
    return spark.createDataFrame(rows, "schema_version string, convention string, row_count long, first string, last string, rows_dropped long, series string, n_rows long, series_first string, series_last string")


# --- readers ---------------------------------------------------------------------------


def _file(spark: SparkSession, lines: DataFrame, head: list[str], foot: list[str] | None = None) -> str:
    """The path of a file with the lines of (i, line) between a head and a foot."""
    extra = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)] + [(1 << 60, x) for x in foot or []], "i long, line string")
    path = landing.scratch(spark)
    lines.select(F.col("i").cast("long").alias("i"), "line").unionByName(extra).repartition(1).sortWithinPartitions("i").select("line").write.text(path)
    return path


def _fred_file(spark: SparkSession, sf_dir: str, column: str, header: str) -> str:
    value = F.when(F.dayofmonth("date") == 13, ".").when(F.dayofmonth("date") == 14, " NA ").otherwise(F.col(column).cast("string"))
    return _file(spark, _daily(spark, sf_dir).select(F.unix_date("date").alias("i"), F.concat_ws(",", F.col("date").cast("string"), value).alias("line")), [header])


def _fred_sql(series: str, column: str) -> str:
    return f"SELECT '{series}' AS series, date AS obs_date, CASE WHEN day(date) NOT IN (13, 14) THEN {column}::DOUBLE END AS value, row_number() OVER (ORDER BY date) AS ordinal FROM daily"


@query(f"WITH {DAILY} SELECT * FROM ({_fred_sql('us10y', 'top')}) WHERE obs_date >= DATE '1996-02-29'")
def fred_feed(spark, sf_dir):
    return feeds.fred(spark, _fred_file(spark, sf_dir, "top", "observation_date,us10y"), "us10y", dt.date(1996, 2, 29))


@query(f"WITH {DAILY} {_fred_sql('us2y', 'n')} UNION ALL {_fred_sql('us10y', 'top')}")
def fred_feeds(spark, sf_dir):
    paths = {"us2y": _fred_file(spark, sf_dir, "n", "DATE,DGS2"), "us10y": _fred_file(spark, sf_dir, "top", '"DATE","DGS10"')}
    return feeds.fred_all(spark, paths, codes={"us2y": "DGS2", "us10y": "DGS10"})


def _mof_file(spark: SparkSession, sf_dir: str, since: int = 1900, sign: int = 1) -> str:
    d = F.dayofmonth("date")
    day = F.when(d % 2 == 0, F.date_format("date", "yyyy-M-d")).otherwise(F.date_format("date", "yyyy/M/d"))
    two = F.when(d == 3, "-").when(d == 4, "").otherwise((F.col("n") * sign).cast("string"))
    lines = _daily(spark, sf_dir).filter(F.year("date") >= since).select(F.unix_date("date").alias("i"), F.concat_ws(",", day, F.lit('"1,5"'), two, (F.col("top") * sign).cast("string")).alias("line"))
    return _file(spark, lines, ["\ufeffYields,,,(percent)", "Date,1Y,2Y,10Y"], ["end of table,,,"])


def _mof_sql(since: int = 1900, sign: int = 1) -> str:
    rows = f"(SELECT *, row_number() OVER (ORDER BY date) + 1 AS ordinal FROM daily WHERE year(date) >= {since})"
    return f"SELECT 'jgb2y' AS series, date AS obs_date, CASE WHEN day(date) NOT IN (3, 4) THEN ({sign} * n)::DOUBLE END AS value, ordinal FROM {rows} UNION ALL SELECT 'jgb10y', date, {sign} * top, ordinal FROM {rows}"


@query(f"WITH {DAILY} {_mof_sql()}")
def mof_feed(spark, sf_dir):
    """Titles above the header, two forms of dates, marks for missing values, a quoted cell and a footer."""
    return feeds.mof(spark, _mof_file(spark, sf_dir), {"jgb2y": "2Y", "jgb10y": "10Y"})


@query(f"WITH {DAILY} SELECT count(*) + 2 AS ordinal, 'end of table,,,' AS line FROM daily")
def mof_rejects(spark, sf_dir):
    return feeds.mof_rejects(spark, _mof_file(spark, sf_dir)).select("ordinal", "line")


BARS = """bars AS (SELECT CAST(ts AS DATE) AS obs_date, event_id AS ordinal, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events),
fx AS (SELECT 'usdjpy' AS series, obs_date, value FROM (SELECT *, row_number() OVER (PARTITION BY obs_date ORDER BY ordinal DESC) AS r FROM bars) WHERE r = 1 AND value IS NOT NULL)"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string"))
    return _read(spark, sf_dir, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+09:00")).alias("date"), F.lit("1").alias("Open|USDJPY=X"), close.alias("Close|USDJPY=X"), F.col("event_id").alias("ordinal"))


@query(f"WITH {BARS} SELECT * FROM fx")
def yahoo_feed(spark, sf_dir):
    """Local days of stamps with a zone; a day whose last bar has no close is missing."""
    return feeds.yahoo(_bars(spark, sf_dir), "usdjpy", "USDJPY=X").select("series", "obs_date", "value")


@query(f"""WITH {DAILY}, {BARS}, old AS ({_mof_sql()}), new AS ({_mof_sql(1998, -1)}), bonds AS (SELECT series, obs_date, value FROM new UNION ALL SELECT series, obs_date, value FROM old ANTI JOIN new USING (series, obs_date))
SELECT * FROM (SELECT series, obs_date, value FROM ({_fred_sql('us2y', 'n')}) UNION ALL SELECT series, obs_date, value FROM ({_fred_sql('us10y', 'top')}) UNION ALL SELECT * FROM bonds UNION ALL SELECT * FROM fx) WHERE obs_date >= DATE '1997-12-02'""")
def fetched_feeds(spark, sf_dir):
    """All feeds of a run that starts on 1998-01-02, from 31 days before; the later bond file wins where both have a day."""
    landed = {"fred": {"us2y": _fred_file(spark, sf_dir, "n", "DATE,DGS2"), "us10y": _fred_file(spark, sf_dir, "top", "DATE,DGS10")}, "mof": [_mof_file(spark, sf_dir), _mof_file(spark, sf_dir, 1998, -1)], "yahoo": _bars(spark, sf_dir)}
    return feeds.fetch_all(spark, _config("ny_close", "1998-01-02", "2024-01-30"), landed)
