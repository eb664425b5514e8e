"""Hand-built fixture: every value shows the day it was observed on (base + day / 100)."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftgrid.config import ConfigError, parse, policy_rows
from driftgrid.operators import align, asof, calendars, dedup, validate

BASES = {"usdjpy": 160.0, "us2y": 4.0, "us10y": 4.0, "us10y_real": 2.0, "jgb2y": 0.0, "jgb10y": 1.0}
SERIES = list(BASES)


def settings(convention="ny_close", start="2024-07-01", end="2024-07-19", **lags):
    shifted = convention == "tokyo_close"
    exact = ["jgb2y", "jgb10y"] if shifted else ["usdjpy", "us2y", "us10y"]
    asof_lags = {"usdjpy": 5, "us2y": 5, "us10y": 5, "us10y_real": 5} if shifted else {"jgb2y": 7, "jgb10y": 7, "us10y_real": 4}
    return {
        "project": {"start_date": start, "end_date": end},
        "sources": {"fred": {"series": {"us2y": "DGS2"}}, "mof": {"tenors": {"jgb2y": "2Y"}}},
        "alignment": {"convention": convention, "drop_if_missing": exact, "asof_max_lag_days": asof_lags | lags},
        "validation": {"bounds": {"usdjpy": [70, 200], "jgb10y": [-1, 10]}, "required_start_before": "2024-07-05", "min_rows": 5, "max_gap_business_days": 5},
    }


def observed(spark, **changes):
    rows = []
    for d in range(1, 20):
        date = dt.date(2024, 7, d)
        for name, base in BASES.items():
            away = d == 4 and name.startswith("us") and name != "usdjpy" or d == 15 and name.startswith("jgb")
            if date.weekday() < 5 and not away:
                rows.append((name, date, changes.get(f"{name}_{d}", base + d / 100)))
    return spark.createDataFrame(rows, "series string, obs_date date, value double")


def test_new_york_close(spark):
    a = align.align(spark, observed(spark), parse(settings()), SERIES)
    found = align.report(a)
    assert a.daily.columns == ["date", "usdjpy", "us2y", "us10y", "jgb2y", "jgb10y", "spread2y", "spread10y", "us10y_real", "fx_lag_days", "us_lag_days", "jgb_lag_days"]
    assert found["rows_out"] == 14 and found["rows_dropped"] == 1
    assert found["dropped_by_reason"] == {"us10y/missing_on_snapshot_date": 1, "us2y/missing_on_snapshot_date": 1}
    assert {s: c["carried_forward"] for s, c in found["carries"].items() if c["carried_forward"]} == {"jgb2y": 1, "jgb10y": 1}
    assert found["carries"]["jgb10y"]["max_lag"] == 3 and found["carries"]["us2y"]["max_lag"] == 0
    assert found["gaps"] == {f"{s}/holiday": 1 for s in SERIES if s != "usdjpy"} and not found["unexplained"]
    row = align.at_date(a.daily, dt.date(2024, 7, 15)).first()
    assert row["jgb10y"] == pytest.approx(1.12) and row["jgb_lag_days"] == 3 and row["spread10y"] == pytest.approx(4.15 - 1.12)


def test_tokyo_close(spark):
    a = align.align(spark, observed(spark), parse(settings("tokyo_close")), SERIES)
    found = align.report(a)
    assert found["rows_out"] == 13 and found["rows_dropped"] == 2
    assert found["dropped_by_reason"] == {"jgb10y/missing_on_snapshot_date": 1, "jgb2y/missing_on_snapshot_date": 1, "us10y/stale_beyond_max_lag": 1, "us2y/stale_beyond_max_lag": 1, "usdjpy/stale_beyond_max_lag": 1}
    assert {s: c["carried_over_one"] for s, c in found["carries"].items()} == {"usdjpy": 1, "us2y": 2, "us10y": 2, "us10y_real": 2, "jgb2y": 0, "jgb10y": 0}
    assert {s: c["carried_forward"] for s, c in found["carries"].items()}["us2y"] == 1
    friday = align.at_date(a.daily, dt.date(2024, 7, 5)).first()
    assert friday["us_lag_days"] == 2 and friday["us2y"] == pytest.approx(4.03) and friday["fx_lag_days"] == 1


def test_no_look_ahead_and_stale_limit(spark):
    rows = align.align(spark, observed(spark, jgb2y_16=99.0), parse(settings()), SERIES).daily
    assert align.at_date(rows, dt.date(2024, 7, 15)).first()["jgb2y"] == pytest.approx(0.12)
    assert align.align(spark, observed(spark), parse(settings(jgb2y=1, jgb10y=1)), SERIES).daily.count() == 13


def test_windows_and_errors(spark):
    assert align.align(spark, observed(spark), parse(settings(start="2024-07-08", end="2024-07-12")), SERIES).daily.count() == 5
    with pytest.raises(ConfigError):
        align.align(spark, observed(spark), parse(settings()), SERIES[1:])
    with pytest.raises(ConfigError):
        policy_rows(parse(settings()).alignment, [*SERIES, "gold"])


@pytest.mark.parametrize("change", [{"colour": 1}, {"alignment": {"drop_if_missing": ["jgb2y"], "asof_max_lag_days": {"jgb2y": 1}}}, {"validation": {"bounds": {"usdjpy": [2, 1]}, "required_start_before": "2024-01-01"}}])
def test_bad_settings(change):
    with pytest.raises(ConfigError):
        parse(settings() | change)


def test_asof_tolerance(spark):
    day = lambda d: dt.date(2024, 7, d)
    obs = spark.createDataFrame([("a", day(1), 1.0, 0), ("a", day(1), 1.5, 1), ("a", day(2), None, 0), ("a", day(10), 2.0, 0), (None, day(3), 9.0, 0)], "series string, obs_date date, value double, ordinal int")
    targets = spark.createDataFrame([("a", day(d)) for d in (1, 3, 9, 10)] + [("b", day(1)), (None, day(3)), ("a", None)], "series string, target date")
    rules = spark.createDataFrame([("a", 2)], "series string, max_lag int")
    got = {(r["series"], r["target"]): r["value"] for r in asof.asof_lookup(targets, obs, rules).collect()}
    assert [got["a", day(d)] for d in (1, 3, 9, 10)] == [1.5, 1.5, None, 2.0] and got["b", day(1)] is None and got["a", None] is None
    far = {(r["series"], r["target"]): r["value"] for r in asof.asof_unbounded(targets.filter("series = 'a' and target is not null"), obs).collect()}
    assert far["a", day(9)] == 1.5 and far["a", day(10)] == 2.0
    assert asof.asof_lookup(targets.limit(0), obs, rules).count() == 0
    first, last = targets.agg(F.min("target"), F.max("target")).first()
    most = rules.agg(F.max("max_lag")).first()[0]
    assert {(r["series"], r["target"]): r["value"] for r in asof.asof_lookup(targets, obs, rules, most, (first, last)).collect()} == got
    # a long tolerance takes the other way, with the same answers
    long = {(r["series"], r["target"]): r["value"] for r in asof.asof_lookup(targets, obs, rules, longest=400).collect()}
    assert long == got
    wide = spark.createDataFrame([("a", 400)], "series string, max_lag int")
    assert sorted(map(str, asof.asof_lookup(targets, obs, wide, longest=400).collect())) == sorted(map(str, asof.asof_lookup(targets, obs, wide).collect()))


def test_calendars(spark):
    us, jp = calendars.closures("us", 2024), calendars.closures("jp", 2024)
    assert {dt.date(2024, 3, 29), dt.date(2024, 7, 4), dt.date(2024, 10, 14), dt.date(2024, 11, 11)} <= set(us)
    assert {dt.date(2024, 7, 15), dt.date(2024, 1, 3), dt.date(2024, 12, 31), dt.date(2024, 5, 6)} <= set(jp)
    assert dt.date(2024, 7, 10) not in us and dt.date(2021, 12, 31) in calendars.closures("us", 2021)
    assert dt.date(2020, 7, 24) in calendars.closures("jp", 2020) and dt.date(2015, 9, 22) in calendars.closures("jp", 2015)
    rows = calendars.weekday_calendar(spark, dt.date(2024, 7, 1), dt.date(2024, 7, 9), [0, 1, 3]).orderBy("date").collect()
    assert [(r["date"].day, r["back"]) for r in rows] == [(1, 4), (2, 1), (4, 2), (8, 4), (9, 1)]
    assert calendars.weekday_calendar(spark, dt.date(2024, 7, 2), dt.date(2024, 7, 1)).count() == 0
    days = [dt.date(2024, 7, d) for d in (4, 10, 30, 31)]
    cal = spark.createDataFrame([(d, 1) for d in days], "date date, back int")
    none = spark.createDataFrame([], "series string, obs_date date, value double")
    got = calendars.classify_gaps(none, spark.createDataFrame([("x", "us")], "series string, market string"), cal, calendars.holidays(spark, days[0], days[-1]), days[-1], 2).orderBy("date").collect()
    assert [r["reason"] for r in got] == ["holiday", "unexplained", "publication_lag", "publication_lag"]


def test_merge_and_keep_last(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 1, "only"), (None, 1, "n")], "k int, ordinal int, v string")
    b = spark.createDataFrame([(1, 1, None), (1, 0, "first")], "k int, ordinal int, v string")
    assert {(r.k, r.v) for r in dedup.priority_merge([a, b], ["k"], ["ordinal"]).collect()} == {(1, None), (2, "only"), (None, "n")}


def _table(spark, edit=lambda rows: rows):
    days = [dt.date(2024, 7, 1) + dt.timedelta(d) for d in range(60)]
    rows = [[d, 160.0, 4.0, 4.5, 0.4, 1.0, 3.6, 3.5, 0, 0, 0] for d in days if d.weekday() < 5]
    return spark.createDataFrame([tuple(r) for r in edit(rows)], "date date, usdjpy double, us2y double, us10y double, jgb2y double, jgb10y double, spread2y double, spread10y double, fx_lag_days int, us_lag_days int, jgb_lag_days int")


def _set(i, j, value):
    def edit(rows):
        rows[i][j] = value
        return rows

    return edit


@pytest.mark.parametrize(
    ("edit", "checks"),
    [
        (lambda r: r, set()),
        (_set(3, 3, None), {"nan", "consistency"}),
        (lambda r: [*r, r[-1]], {"dates"}),
        (_set(3, 1, 250.0), {"bounds"}),
        (_set(3, 7, 9.0), {"consistency"}),
        (_set(3, 8, -1), {"lags"}),
        (lambda r: r[:5] + r[15:], {"gaps"}),
        (lambda r: r[:5] + r[8:], set()),
        (lambda r: r[:2], {"rows", "coverage"}),
        (lambda r: r[8:], {"coverage"}),
        (_set(3, 0, dt.date(2024, 7, 6)), {"dates"}),
    ],
)
def test_one_defect(spark, edit, checks):
    config = parse(settings(end="2024-08-29"))
    found = validate.validate(_table(spark, edit), config)
    assert {r["check"] for r in found.rows()} == checks
    assert found.ok == (not checks) and ("PASS" if not checks else "FAIL") in validate.markdown(found)


def test_odd_tables(spark):
    config = parse(settings(end="2024-08-29"))
    assert {r["check"] for r in validate.validate(_table(spark, lambda r: r).limit(0), config).rows()} == {"rows"}
    assert {r["check"] for r in validate.validate(_table(spark).drop("jgb2y"), config).rows()} == {"schema"}
    assert {(r["check"], r["level"]) for r in validate.validate(_table(spark).selectExpr("*", "1 as extra"), config, {"row_count": 1}).rows()} == {("schema", "warning"), ("metadata", "error")}
    assert validate.validate(_table(spark), config).stats["coverage_pct"] == 100.0


def test_stored_order_and_many_gaps(spark):
    config = parse(settings(start="2015-01-01", end="2024-08-29"))
    table = _table(spark).withColumn("i", F.row_number().over(Window.orderBy("date")))
    swapped = table.withColumn("i", F.when(F.col("i") == 5, 6).when(F.col("i") == 6, 5).otherwise(F.col("i")))
    assert not validate.validate(table, config, ordinal="i").findings.filter("subject = 'order'").count()
    assert [(r["check"], r["n"]) for r in validate.validate(swapped, config, ordinal="i").rows() if r["subject"] == "order"] == [("dates", 1)]
    assert validate.unsorted_rows(swapped, "i", stretch=5).count() == 1  # the two rows are in different stretches
    days = [(dt.date(2015, 1, 5) + dt.timedelta(14 * k),) for k in range(30)]
    spaced = spark.createDataFrame(days, "date date").join(_table(spark).drop("date").limit(1))
    found = [r for r in validate.validate(spaced, config).rows() if r["check"] == "gaps"]
    assert len(found) == 21 and {r["n"] for r in found if r["subject"] != "more"} == {9} and [r["n"] for r in found if r["subject"] == "more"] == [9]
    assert validate.gaps(spaced).count() == 29 and validate.gaps(spaced.limit(0)).count() == 0
    stamped = _table(spark).withColumn("date", F.col("date").cast("timestamp") + F.expr("interval 3 hours"))
    assert {r["check"] for r in validate.validate(stamped, parse(settings(end="2024-08-29"))).rows()} >= {"schema", "dates"}
    holed = _table(spark).withColumn("us10y_real", F.when(F.dayofmonth("date") > 5, 1.0))
    assert {(r["check"], r["level"]) for r in validate.validate(holed, parse(settings(end="2024-08-29"))).rows()} == {("nan", "warning")}
